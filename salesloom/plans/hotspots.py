"""Selling sites and item profits for one menu type in one city."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from salesloom.functions.calendar import with_calendar
from salesloom.functions.fixed_values import CITY_CENTERS, MODEL_TREES, TOP_N
from salesloom.operators import model_store, profit, sites
from salesloom.operators.filters import Choice, at_location, has_rows


class Hotspots:
    """Location totals and seasonal item profits, and the results built on them.

    Both come from one aggregate, so that the facts are scanned once. It is cached on
    first use and released by ``close`` or at the end of a ``with`` block. The model is a
    stored one where these totals have been trained on before. Without a sale there is
    nothing to train on: no model, and scores without rows. ``centers`` gives the centres
    of known cities.
    """

    def __init__(
        self,
        sales: DataFrame,
        menu_type: str,
        city: str,
        categories: Choice = None,
        centers: Iterable[tuple[str, float, float]] = CITY_CENTERS,
        trees: int = MODEL_TREES,
    ):
        self.menu_type, self.center, self.trees = menu_type, sites.center_of(city, centers), trees
        self.categories = categories
        self.sales = with_calendar(sales.transform(at_location, menu_type, city, categories))
        amounts = ("price", "unit_price", "cost_of_goods_usd")
        self.cube = (
            self.sales.groupBy(*sites.LOCATION_KEYS, "city", "menu_item_name")
            .agg(*(F.sum(name).alias(name) for name in amounts), *(F.count(name).alias(f"n_{name}") for name in amounts))
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        self.locations = sites.location_sales(self.cube)
        self.profits = profit.item_season_profit(self.cube)

    def __enter__(self) -> Hotspots:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.cube.unpersist()

    def found(self) -> bool:
        """Whether the choice matches any sale; without one there is no model."""
        return has_rows(self.cube)

    @cached_property
    def model(self) -> PipelineModel | None:
        return model_store.site_model(self.locations, self.trees)

    def candidates(self) -> DataFrame:
        return sites.candidate_sites(self.locations, self.menu_type, self.center, self.categories)

    def scores(self) -> DataFrame:
        return sites.score_sites(self.model, self.candidates())

    def heat_points(self) -> DataFrame:
        return sites.heat_points(self.scores())

    def metrics(self) -> DataFrame:
        return sites.model_metrics(self.model, self.locations)

    def top_items(self, n: int = TOP_N) -> DataFrame:
        return profit.top_items(self.profits, n)

    def top_item_cards(self, n: int = TOP_N) -> DataFrame:
        return profit.item_cards(self.top_items(n))

    def season_series(self, n: int = TOP_N) -> DataFrame:
        return profit.top_item_season_series(self.profits, n)
