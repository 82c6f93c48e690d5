"""All results of the sales projection, from one scan of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from salesloom.functions.fixed_values import TOP_N
from salesloom.operators import forecast, menus, summaries, weekly
from salesloom.operators.filters import SalesFilter
from salesloom.operators.options import levels


class SalesProjection:
    """Filtered sales as a shared aggregate, and the results built on it.

    The aggregate has one row per day, subcategory, category and menu type that
    sold anything; it is the only thing that scans the facts. It is cached on
    first use, in memory and else on disk, and Spark recomputes parts of it that
    are lost with an executor. Use as a context manager, or call ``close``.
    """

    def __init__(self, sales: DataFrame, chosen: SalesFilter = SalesFilter()):
        self.cube = summaries.sales_cube(sales.transform(chosen)).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> SalesProjection:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.cube.unpersist()

    def summary(self) -> DataFrame:
        return summaries.subcategory_summary(self.cube)

    def cards(self, n: int = TOP_N) -> DataFrame:
        return summaries.subcategory_cards(summaries.top_subcategories(self.summary(), n))

    def daily_series(self, n: int = TOP_N) -> DataFrame:
        return summaries.top_daily_series(self.cube, n)

    def daily_pivot(self) -> DataFrame:
        daily = summaries.daily_category_sales(self.cube)
        return summaries.daily_category_pivot(daily, levels(self.cube, "item_category"))

    def weekly(self) -> DataFrame:
        return weekly.weekly_category_sales(self.cube)

    def trend(self) -> DataFrame:
        return forecast.category_trend(self.weekly())

    def forecast(self, periods: int = forecast.FORECAST_DAYS, step_days: int = 1) -> DataFrame:
        return forecast.actual_vs_forecast(self.weekly(), periods, step_days)

    def forecast_fits(self) -> DataFrame:
        return forecast.forecast_fits(self.weekly())

    def top_menus(self, menu_table: DataFrame, n: int = TOP_N) -> DataFrame:
        return menus.menu_top(menus.sales_by_menu_rated(self.cube, menu_table), n)
