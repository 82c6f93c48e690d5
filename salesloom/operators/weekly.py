"""Weekly totals without gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.calendar import week_end, with_date
from salesloom.functions.names import quoted, value_of
from salesloom.operators.options import sums_by_level


def weekly_totals(sales: DataFrame) -> DataFrame:
    """Sales of each category in each week that has any, by the week's Sunday."""
    dated = with_date(sales).filter(F.col("date").isNotNull())
    return dated.groupBy(week_end(F.col("date")).alias("week_end"), "item_category").agg(
        F.sum("price").alias("y")
    )


def weekly_category_sales(sales: DataFrame) -> DataFrame:
    """Weekly sales of each category, with 0 for the weeks without sales.

    All categories run over the same weeks: from the first week with a sale of
    any category to the last one, which is left out as incomplete.

    Each category becomes one row that holds its weeks as a map; the calendar
    bounds a map's size, however many order lines a category has. Unfolding the
    week range against that map needs no join. The range is taken over whole
    (week, total) pairs, not over weeks alone: so both uses of the weekly totals
    ask for the same columns, Spark runs their shuffle once, and the facts are
    scanned once.
    """
    totals = weekly_totals(sales)
    pair = F.struct("week_end", "y")
    first = totals.select(F.min(pair)["week_end"]).scalar()
    last = totals.select(F.max(pair)["week_end"]).scalar()
    by_category = totals.groupBy("item_category").agg(
        F.map_from_entries(F.collect_list(pair)).alias("sold")
    )
    weeks = F.explode(F.sequence(first, last, F.expr("INTERVAL 7 DAYS")))
    return (
        by_category.select("item_category", "sold", weeks.alias("week_end"))
        .filter(F.col("week_end") < last)
        .select(
            "week_end",
            "item_category",
            F.coalesce(F.try_element_at("sold", "week_end"), F.lit(0.0)).alias("y"),
        )
    )


def weekly_wide(weekly: DataFrame, categories: Sequence[str | None]) -> DataFrame:
    """One row per week with one column per category, named by ``column_names``."""
    return sums_by_level(weekly, "week_end", "item_category", categories, "y")


def weekly_long(wide: DataFrame) -> DataFrame:
    """Back to one row per week and category."""
    sold = F.array(
        *(
            F.struct(F.lit(value_of(name)).cast("string").alias("item_category"), F.col(quoted(name)).alias("y"))
            for name in wide.columns
            if name != "week_end"
        )
    )
    return wide.select("week_end", F.inline(sold))


def weekly_runs(sales: DataFrame) -> DataFrame:
    """``weekly_category_sales`` with each stretch of weeks without a sale as one row.

    Rows hold the first week of a run, its number of weeks and the sales of each. So a
    single sale of a mistyped year adds a row for each category and not a row for each
    week in between; ``unfolded`` gives the weeks one by one.
    """
    totals = weekly_totals(sales)
    pair = F.struct("week_end", "y")
    first = totals.select(F.min(pair)["week_end"]).scalar()
    last = totals.select(F.max(pair)["week_end"]).scalar()
    by_category = totals.groupBy("item_category").agg(F.sort_array(F.collect_list(pair)).alias("sold"))
    by_category = by_category.select("item_category", "sold", first.alias("first"), last.alias("last"))

    def run(week: Column, weeks: Column, y: Column) -> Column:
        return F.struct(week.alias("week_end"), weeks.cast("int").alias("weeks"), y.alias("y"))

    def without_sales(before: Column, after: Column) -> Column:
        return run(F.date_add(before, 7), F.datediff(after, before) / 7 - 1, F.lit(0.0))

    def with_gap(sold: Column, place: Column) -> Column:
        before = F.when(place == 0, F.date_sub(F.col("first"), 7)).otherwise(F.try_element_at("sold", place)["week_end"])
        return F.array(without_sales(before, sold["week_end"]), run(sold["week_end"], F.lit(1), F.coalesce(sold["y"], F.lit(0.0))))

    ending = without_sales(F.element_at("sold", -1)["week_end"], F.col("last"))
    runs = F.concat(F.flatten(F.transform("sold", with_gap)), F.array(ending))
    unfolded = by_category.select("item_category", "last", F.inline(runs))
    return unfolded.where("weeks > 0 AND week_end < last").select("week_end", "item_category", "weeks", "y")


def unfolded(runs: DataFrame) -> DataFrame:
    """The weeks of ``weekly_runs`` one by one, as ``weekly_category_sales`` has them."""
    weeks = runs.select("*", F.explode(F.sequence(F.lit(0), F.col("weeks") - 1)).alias("at"))
    return weeks.select(F.date_add("week_end", F.col("at") * 7).alias("week_end"), "item_category", "y")
