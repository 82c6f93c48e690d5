"""A table kept in order: sorted ranges with their bounds, so no reader sorts it again."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesloom.functions.names import quoted

#: Column that the table has besides the written ones: the number of the range.
PART = "part"


def _order(by: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(quoted(name)).asc() if ascending else F.col(quoted(name)).desc() for name, ascending in by]


def write_ordered(rows: DataFrame, path: str, by: Sequence[tuple[str, bool]], mode: str = "error", ranges: int | None = None) -> None:
    """Writes rows in the order of ``by``, pairs of a column and whether it ascends.

    Rows go to sorted ranges, one folder each, numbered in order; ranges are told apart by
    a hash of the row after the columns of ``by``, so that a frequent key is spread over
    several. Beside them lies a row for each range: its number of rows, the least and the
    greatest value of each column of ``by``, and how many values are null there. Without a
    number of ``ranges`` Spark chooses it by the rows' size.
    """
    if PART in (name.lower() for name in rows.columns):
        raise ValueError(f"a column {PART} is there already")
    order = _order(by)
    placed = rows.repartitionByRange(*([ranges] if ranges else []), *order, F.xxhash64(*(F.col(quoted(name)) for name in rows.columns)))
    placed = placed.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    placed.write.mode(mode).partitionBy(PART).parquet(f"{path}/rows")
    # Read from the files: the ranges that were written, whichever attempt of a task wrote them.
    spark, schema = rows.sparkSession, placed.schema
    bounds = []
    for k, (name, _) in enumerate(by):
        value = F.col(quoted(name))
        bounds += [F.min(value).alias(f"least{k}"), F.max(value).alias(f"most{k}"), F.count_if(value.isNull()).alias(f"nulls{k}")]
    written = spark.read.schema(schema).parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("n_rows"), *bounds)
    written.coalesce(1).write.mode(mode).parquet(f"{path}/bounds")
    told = F.lit(json.dumps(list(by))).alias("by"), F.lit(schema.json()).alias("schema")
    spark.range(1).select(*told).coalesce(1).write.mode(mode).parquet(f"{path}/about")


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """A row for each range: its number, rows and bounds."""
    return spark.read.parquet(f"{path}/bounds")


def _ranges(spark: SparkSession, path: str) -> list[Row]:
    """The ranges in order, as many rows as the table has files."""
    return sorted(read_bounds(spark, path).collect(), key=lambda row: row[PART])


def ordered_by(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    return [tuple(pair) for pair in json.loads(spark.read.parquet(f"{path}/about").first()["by"])]


def _read(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/about").first()["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/rows").where(F.col(PART).isin(parts))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` rows of the order, from the ranges that hold them; the others are not read."""
    parts, held = [], 0
    for row in _ranges(spark, path):
        if held >= n:
            break
        parts.append(row[PART])
        held += row["n_rows"]
    return _read(spark, path, parts).orderBy(PART, *_order(ordered_by(spark, path))).limit(n).drop(PART)


def rows_between(spark: SparkSession, path: str, least: object, most: object) -> DataFrame:
    """Rows whose first column of the order lies within two values, from the ranges that can hold any."""
    parts = [row[PART] for row in _ranges(spark, path) if row["least0"] is not None and row["least0"] <= most and row["most0"] >= least]
    first, _ = ordered_by(spark, path)[0]
    return _read(spark, path, parts).drop(PART).where(F.col(quoted(first)).between(F.lit(least), F.lit(most)))


def rows_in_order(spark: SparkSession, path: str) -> Iterator[Row]:
    """All rows in order, range by range; one range at a time is sorted and comes to the driver in parts."""
    by = ordered_by(spark, path)
    for row in _ranges(spark, path):
        yield from _read(spark, path, [row[PART]]).drop(PART).orderBy(*_order(by)).toLocalIterator()


def overlaps(spark: SparkSession, path: str) -> int:
    """Ranges whose first column reaches back before that of an earlier range; none in a whole table."""
    (_, ascending), *_ = ordered_by(spark, path)
    count, reached = 0, None
    for row in _ranges(spark, path):
        if row["least0"] is None:
            continue
        begin, end = (row["least0"], row["most0"]) if ascending else (row["most0"], row["least0"])
        count += reached is not None and (begin < reached if ascending else begin > reached)
        reached = end
    return count
