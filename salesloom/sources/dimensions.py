"""Small literal tables: menus and city centres."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from salesloom.functions.fixed_values import CITY_CENTERS, MENUS


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: pa.Schema) -> DataFrame:
    """Table of literal rows.

    Built from Arrow, it becomes a local relation whose size the optimizer
    knows. Joins then broadcast it only while it is under Spark's broadcast
    threshold; a table made from plain Python rows has no known size.
    """
    columns = zip(*rows)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema) if arrays else schema.empty_table())


def menu_table(spark: SparkSession, menus: Iterable[tuple[str, float, str]] = MENUS) -> DataFrame:
    """Menu type, customer rating and picture."""
    schema = pa.schema([("menu_type", pa.string()), ("rating", pa.float64()), ("image", pa.string())])
    return literal_table(spark, menus, schema)


def city_table(
    spark: SparkSession, centers: Iterable[tuple[str, float, float]] = CITY_CENTERS
) -> DataFrame:
    """City with the latitude and longitude of its centre."""
    schema = pa.schema([("city", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])
    return literal_table(spark, centers, schema)
