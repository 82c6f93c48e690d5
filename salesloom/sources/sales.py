"""The sales facts table: one row per order line, stored as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.encoding import HASH_SHARES, hash_share
from salesloom.functions.fixed_values import GEO_COLUMNS, OPTION_SAMPLE_FRACTION, SALES_COLUMNS, SALES_SAMPLE_SEED

ALL_COLUMNS = tuple(dict.fromkeys(SALES_COLUMNS + GEO_COLUMNS))


def read_sales(spark: SparkSession, path: str, columns: Sequence[str] = ALL_COLUMNS) -> DataFrame:
    """Scan of the facts table. Names match in any letter case and come out lower case."""
    return spark.read.parquet(path).select(*columns)


def sample_sales(
    sales: DataFrame, fraction: float = OPTION_SAMPLE_FRACTION, seed: int = SALES_SAMPLE_SEED
) -> DataFrame:
    """Random sample, for a first look only: rare values can be missing from it."""
    return sales.sample(fraction=fraction, seed=seed)


def sample_by_key(
    sales: DataFrame, keys: Sequence[str], fraction: float = OPTION_SAMPLE_FRACTION, seed: int = SALES_SAMPLE_SEED
) -> DataFrame:
    """Sample by a hash of a line's keys: the same lines on any partitioning, cluster or engine.

    Of two samples of one seed, that of the smaller fraction lies within the other. Lines
    that share all keys stay or go together.
    """
    share = hash_share(F.lit(seed), *(F.col(key) for key in keys))
    return sales.where(share < F.lit(int(fraction * HASH_SHARES)))


def write_sales(sales: DataFrame, path: str, mode: str = "error") -> None:
    """Writes facts in the layout that the filters can skip through.

    The rebalance hint lets AQE size the output files and split a hot year over
    many tasks; sorting inside each file gives its row groups narrow ranges of
    city, menu type and time, so their statistics prune.
    """
    (
        sales.withColumn("order_year", F.year("order_ts"))
        .hint("rebalance", "order_year")
        .sortWithinPartitions("order_year", "city", "menu_type", "order_ts")
        .drop("order_year")
        .write.mode(mode)
        .parquet(path)
    )


def write_result(result: DataFrame, path: str, mode: str = "error") -> None:
    """Writes any result from the executors, without a detour over the driver."""
    result.write.mode(mode).parquet(path)
