"""What there is to choose from: distinct values and years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.functions.names import column_names

OPTION_COLUMNS = ("truck_brand_name", "city", "item_category", "menu_type")


def distinct_values(rows: DataFrame, columns: Sequence[str] = OPTION_COLUMNS) -> DataFrame:
    """Distinct values of several columns as (option, value) rows, in one scan.

    Each task collects a set for each column while it reads, so that a single row leaves
    it, however many lines it read. Sets are unfolded and made distinct over all tasks
    where their values meet. A task's memory holds its distinct values; columns with
    about as many values as rows are better made distinct one by one.
    """
    sets = (F.collect_set(F.struct(F.col(name).cast("string").alias("value"))).alias(f"s{k}") for k, name in enumerate(columns))
    by_task = rows.select(*columns).withColumn("task", F.spark_partition_id()).groupBy("task").agg(*sets)
    options = F.array(*(F.struct(F.lit(name).alias("option"), F.col(f"s{k}").alias("found")) for k, name in enumerate(columns)))
    return by_task.select(F.inline(options)).select("option", F.inline("found")).distinct()


def year_bounds(sales: DataFrame) -> DataFrame:
    """First and last year of the sales, and whether they are the same."""
    bounds = sales.agg(
        F.year(F.min("order_ts")).alias("min_year"), F.year(F.max("order_ts")).alias("max_year")
    )
    return bounds.withColumn("single_year", F.col("min_year") == F.col("max_year"))


def levels(rows: DataFrame, column: str) -> list[str | None]:
    """Sorted distinct values of ``column``, null last, for results with one column per value.

    The one place where values come to the driver: they are about to become
    column names. Like a pivot without a value list it runs a job, and it refuses
    more values than Spark lets a pivot have rather than leave any out.
    """
    most = int(rows.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = rows.select(column).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values, too many for columns")
    return sorted((row[0] for row in found), key=lambda value: (value is None, value))


def sums_by_level(rows: DataFrame, key: str, column: str, values: Sequence[str | None], amount: str) -> DataFrame:
    """One row per ``key`` with the sum of ``amount`` for each value of ``column``, 0 without any.

    Columns are named by ``column_names``, from which ``value_of`` tells the value.
    """
    level = F.col(column)
    return rows.groupBy(key).agg(
        *(
            F.coalesce(F.sum(F.when(level.eqNullSafe(F.lit(value)), F.col(amount))), F.lit(0.0)).alias(name)
            for value, name in zip(values, column_names(values, [key]))
        )
    )
