"""Session defaults for jobs that do not bring their own session."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

# Bytes of input behind one shuffle partition. A partition beyond its share of memory
# spills, and AQE merges the ones that turn out small, so the count errs on the high side.
SHUFFLE_BYTES = 512 * 1024 * 1024

# AQE, skew-join splitting and ANSI mode are on by default in Spark 4; only the
# settings that differ from Spark's defaults are listed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "salesloom", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """Session with the defaults above, overridden by ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_settings(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for queries that read ``input_bytes`` on a cluster of ``cores``.

    Spark's 200 shuffle partitions suit small inputs; with 100 TB each would hold
    hundreds of GB in a join of the star schema. Totals of the wide facts table
    shuffle only what map-side aggregation leaves, and AQE merges them again.
    """
    return {"spark.sql.shuffle.partitions": str(max(input_bytes // SHUFFLE_BYTES, 2 * cores))}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate tables, which ``spark.checkpoint.dir`` names.

    None where the session names none: a made-up, machine-local one would be lost
    with its machine.
    """
    context = spark.sparkContext
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def table_folder(spark: SparkSession) -> str:
    """Where tables of a session's own go: the shared folder, or else the warehouse."""
    return (shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a table, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def stored(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows as a table in the shared folder, for as long as the block lasts.

    A lost executor then costs a read and no new computation. Without a shared folder
    the rows are cached instead.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield rows
        finally:
            rows.unpersist()
        return
    path = f"{folder.rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        remove(spark, path)
