"""Sales totals by subcategory, day and category.

Every operator also takes the shared aggregate of ``sales_cube`` in place of
the facts: its ``price`` is a sum that can be summed again, and ``n_priced``
counts the prices behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.calendar import with_date
from salesloom.functions.fixed_values import TOP_N
from salesloom.functions.labels import money, option_icon, option_type
from salesloom.operators.options import sums_by_level

CUBE_KEYS = ("date", "item_subcategory", "item_category", "menu_type")


def sales_cube(sales: DataFrame) -> DataFrame:
    """The finest totals that all sales results are built from, one scan for all."""
    return (
        with_date(sales)
        .groupBy(*CUBE_KEYS)
        .agg(
            F.sum("price").alias("price"),
            F.count("price").alias("n_priced"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def row_count(sales: DataFrame) -> Column:
    """Order lines behind a group, of facts or of the cube."""
    return F.sum("n_rows") if "n_rows" in sales.columns else F.count(F.lit(1))


def subcategory_summary(sales: DataFrame) -> DataFrame:
    """Average price and total sales of each subcategory."""
    if "n_priced" in sales.columns:
        average = F.try_divide(F.sum("price"), F.sum("n_priced"))
    else:
        average = F.avg("price")
    return sales.groupBy("item_subcategory").agg(
        average.alias("avg_spending"), F.sum("price").alias("total_sales")
    )


def top_subcategories(summary: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` subcategories that sold most; equal totals in order of name."""
    return (
        summary.filter(F.col("item_subcategory").isNotNull())
        .orderBy(F.desc("total_sales"), "item_subcategory")
        .limit(n)
    )


def subcategory_cards(summary: DataFrame) -> DataFrame:
    """Summary rows with option type, icon and the amounts as text."""
    kind = option_type(F.col("item_subcategory"))
    return summary.select(
        "item_subcategory",
        "total_sales",
        "avg_spending",
        kind.alias("option_type"),
        option_icon(kind).alias("icon"),
        money(F.col("total_sales"), 0).alias("total_text"),
        money(F.col("avg_spending"), 2).alias("avg_text"),
    )


def daily_subcategory_sales(sales: DataFrame) -> DataFrame:
    """Total sales of each subcategory and day."""
    return (
        with_date(sales)
        .filter(F.col("item_subcategory").isNotNull())
        .groupBy("item_subcategory", "date")
        .agg(F.sum("price").alias("daily_total"))
    )


def top_daily_series(sales: DataFrame, n: int = TOP_N) -> DataFrame:
    """Daily totals of the best-selling subcategories, in order of day.

    The ranking adds up the same daily totals, so both sides of the join read one
    shuffle and the facts are scanned once. The ranking has each subcategory once,
    which makes an inner join do; the optimizer would push a semi join below the
    daily totals and scan the facts a second time for it.
    """
    daily = daily_subcategory_sales(sales)
    ranking = daily.groupBy("item_subcategory").agg(F.sum("daily_total").alias("total_sales"))
    best = top_subcategories(ranking, n).select("item_subcategory")
    return daily.join(best, "item_subcategory").orderBy("item_subcategory", "date")


def daily_category_sales(sales: DataFrame) -> DataFrame:
    """Total sales of each item category and day."""
    return with_date(sales).groupBy("date", "item_category").agg(F.sum("price").alias("price"))


def daily_category_pivot(daily: DataFrame, categories: Sequence[str | None]) -> DataFrame:
    """One row per day with one column per category, 0 where nothing was sold.

    Sales without a category are in the column "null".
    """
    return sums_by_level(daily, "date", "item_category", categories, "price")
