"""What the operators share: scratch tables in the shared folder, words, hashes, columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these; bytes.split() breaks at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
BREAKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Unset, a temporary one, in local mode only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="salesloom-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Tables of one run, each under a name of its own in the shared folder.

    A written table cuts lineage and survives lost executors. What a returned frame
    still reads stays; the rest can be removed once it has been used. Inside `temporary`
    all of it goes when the block ends.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"
        for made in _temporary[-1:]:
            made.append(self)

    def table(self, df: DataFrame, name: str, mode: str = "error") -> DataFrame:
        df.write.mode(mode).option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def remove(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.folder}/{name}")

    def clear(self) -> None:
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_temporary: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end the tables that operators stored inside.

    Their results read these tables, so they have to be written before the block ends:

        with temporary():
            dedup_lines(docs).write.parquet(path)
    """
    made: list[Scratch] = []
    _temporary.append(made)
    try:
        yield
    finally:
        _temporary.remove(made)
        for scratch in made:
            scratch.clear()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Of what is planned and written inside, Spark removes the shuffle files when it is written.

    For tables that are written once; a frame made inside that runs again would shuffle anew.
    """
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.set(cleanup, before)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as keep it apart from the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """The documents with a number for each row, the same one each time a stored table is read.

    Numbers follow the splits of the table's files. Of a table too small to fill all cores
    Spark makes as many splits as there are cores at the time, so an executor lost or won
    between two reads would renumber the rows. The session keeps the number it has now.
    """
    spark, cores = docs.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(cores, None) is None:
        spark.conf.set(cores, str(spark.sparkContext.defaultParallelism))
    return docs.withColumn(name, F.monotonically_increasing_id())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, those of the empty text for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (the public splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` values; fewer values make one run, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        width = n
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
    return total
