"""Item profits by season, and the most profitable items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.calendar import season_ordinal
from salesloom.functions.fixed_values import SEASON_ORDER, TOP_N
from salesloom.functions.labels import plain_money


def highest(name: str) -> Column:
    """Descending order in which NaN counts as null, and null comes last."""
    return F.nanvl(F.col(name), F.lit(None)).desc_nulls_last()


def item_season_profit(sales: DataFrame) -> DataFrame:
    """Average unit price, cost and profit, and total sales, by city, season and item.

    ``sales`` carry a ``season`` column, or are the cube that ``plans.hotspots`` keeps: its
    amounts are sums that can be summed again, with the counts behind them.
    """

    def mean(name: str) -> Column:
        counted = f"n_{name}" in sales.columns
        return F.try_divide(F.sum(name), F.sum(f"n_{name}")) if counted else F.avg(name)

    return (
        sales.groupBy("city", "season", "item_category", "menu_item_name")
        .agg(
            mean("unit_price").alias("unit_price"),
            mean("cost_of_goods_usd").alias("avg_cost"),
            F.sum("price").alias("total_sales"),
        )
        .withColumn("profit", F.col("unit_price") - F.col("avg_cost"))
    )


def by_profit(profits: DataFrame) -> DataFrame:
    """Most profitable first."""
    return profits.orderBy(highest("profit"), "menu_item_name", "city", "season", "item_category")


def top_items(profits: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` items with the highest profit, as the plain mean of their seasonal means."""
    return (
        profits.groupBy("menu_item_name", "item_category")
        .agg(
            F.avg("avg_cost").alias("avg_cost"),
            F.avg("unit_price").alias("unit_price"),
            F.avg("profit").alias("total_profit"),
        )
        .orderBy(highest("total_profit"), "menu_item_name", "item_category")
        .limit(n)
    )


TOP_ITEMS_SQL = """
SELECT menu_item_name, item_category,
       avg(avg_cost) AS avg_cost, avg(unit_price) AS unit_price, avg(profit) AS total_profit
FROM {profits}
GROUP BY menu_item_name, item_category
ORDER BY nanvl(total_profit, NULL) DESC NULLS LAST, menu_item_name, item_category
LIMIT {n}
"""


def top_items_sql(profits: DataFrame, n: int = TOP_N) -> DataFrame:
    """``top_items`` as a SQL statement over the DataFrame."""
    return profits.sparkSession.sql(TOP_ITEMS_SQL, profits=profits, n=n)


def item_cards(top: DataFrame) -> DataFrame:
    """Top items with their amounts as text."""
    return top.select(
        "menu_item_name",
        "item_category",
        plain_money(F.col("unit_price")).alias("unit_price_text"),
        plain_money(F.col("avg_cost")).alias("cost_text"),
        plain_money(F.col("total_profit")).alias("profit_text"),
    )


def top_item_season_series(profits: DataFrame, n: int = TOP_N) -> DataFrame:
    """Sales by season of each top item, spring to winter.

    An item's seasons add up over all categories it is sold under. The four
    seasons are fixed, so they ride along as four sums while the items are
    ranked: the facts are scanned once, and nothing is joined back.
    """

    def of_season(name: str):
        return F.sum(F.when(F.col("season") == name, F.coalesce("total_sales", F.lit(0.0))))

    items = profits.groupBy("menu_item_name", "item_category").agg(
        F.avg("profit").alias("total_profit"), *(of_season(name).alias(name) for name in SEASON_ORDER)
    )
    same_name = Window.partitionBy("menu_item_name")
    best = (
        items.withColumns({name: F.sum(name).over(same_name) for name in SEASON_ORDER})
        .orderBy(highest("total_profit"), "menu_item_name", "item_category")
        .limit(n)
    )
    return (
        best.unpivot(["menu_item_name", "item_category"], list(SEASON_ORDER), "season", "total_sales")
        .filter(F.col("total_sales").isNotNull())
        .orderBy("menu_item_name", "item_category", season_ordinal(F.col("season")))
    )
