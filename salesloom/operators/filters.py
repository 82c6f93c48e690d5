"""Filters over the sales facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.calendar import within_years
from salesloom.functions.fixed_values import ALL

Choice = str | Sequence[str] | None


def choose(sales: DataFrame, column: str, choice: Choice) -> DataFrame:
    """Rows whose ``column`` is among the chosen values.

    ``None`` or the value "All" keeps every row; an empty list keeps none.
    """
    if choice is None:
        return sales
    values = [choice] if isinstance(choice, str) else list(choice)
    return sales if ALL in values else sales.filter(F.col(column).isin(values))


@dataclass(frozen=True)
class SalesFilter:
    """Choice of brands, cities, item categories and years; use with ``transform``."""

    brands: Choice = None
    cities: Choice = None
    categories: Choice = None
    years: tuple[int, int] | None = None

    def __call__(self, sales: DataFrame) -> DataFrame:
        sales = choose(sales, "truck_brand_name", self.brands)
        sales = choose(sales, "city", self.cities)
        sales = choose(sales, "item_category", self.categories)
        if self.years is None:
            return sales
        return sales.filter(within_years(F.col("order_ts"), *self.years))


def at_location(
    sales: DataFrame, menu_type: str | None, city: str | None, categories: Choice = None
) -> DataFrame:
    """Rows of one menu type in one city. Either one missing keeps no row."""

    def equals(column: str, value: str | None) -> Column:
        return F.col(column) == F.lit(value).cast("string")

    return choose(
        sales.filter(equals("menu_type", menu_type) & equals("city", city)), "item_category", categories
    )


def has_rows(sales: DataFrame) -> bool:
    """Whether there is any row; stops at the first one found."""
    return not sales.isEmpty()
