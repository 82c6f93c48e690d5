"""Best-selling menus of each subcategory, with their ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.fixed_values import TOP_N
from salesloom.operators.summaries import row_count


def sales_by_menu_rated(sales: DataFrame, menus: DataFrame) -> DataFrame:
    """Total sales and average rating by subcategory, menu type and picture.

    Sales shrink to one row per subcategory and menu before they meet the menu
    table, so the join never moves order lines. Menus without an entry stay, with
    null picture and rating. A menu listed twice counts for each entry, as in a
    join of the order lines themselves: the ratings are weighted by their number.
    """
    totals = sales.groupBy("item_subcategory", "menu_type").agg(
        F.sum("price").alias("price"), row_count(sales).alias("n_rows")
    )
    rated_rows = F.when(F.col("rating").isNotNull(), F.col("n_rows"))
    return (
        totals.join(menus, "menu_type", "left")
        .groupBy("item_subcategory", "menu_type", "image")
        .agg(
            F.sum("price").alias("total"),
            F.try_divide(F.sum(F.col("rating") * F.col("n_rows")), F.sum(rated_rows)).alias("rating"),
        )
    )


def menu_top(rated: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` best-selling menus of each subcategory; equal totals in order of name."""
    by_sales = Window.partitionBy("item_subcategory").orderBy(F.desc("total"), "menu_type", "image")
    return (
        rated.filter(F.col("item_subcategory").isNotNull())
        .withColumn("place", F.row_number().over(by_sales))
        .filter(F.col("place") <= n)
    )


def menu_slice(top: DataFrame, subcategory: str) -> DataFrame:
    """The best menus of one subcategory."""
    return top.filter(F.col("item_subcategory") == subcategory).drop("item_subcategory")


def menus_on_sale(sales: DataFrame, menus: DataFrame) -> DataFrame:
    """Every menu type sold, with rating and picture where the menu table has them."""
    return sales.select("menu_type").distinct().join(menus, "menu_type", "left")
