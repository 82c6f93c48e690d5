"""Model features as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.calendar import daypart_ordinal, season_ordinal
from salesloom.functions.names import column_names


def with_ordinals(rows: DataFrame) -> DataFrame:
    """Adds the ordinal codes of season and time of day."""
    return rows.withColumns(
        {
            "season_encoded": season_ordinal(F.col("season")),
            "time_encoded": daypart_ordinal(F.col("time_of_day")),
        }
    )


def one_hot(rows: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level after the first, in place of ``column``.

    The first level in sorted order is the base: it is the row of zeros, as is
    a value outside ``levels``. After the column's name, flags are named by
    ``column_names``, so that none takes the name of another column.
    """
    ordered, start = sorted(levels), f"{column}_"
    taken = [name[len(start) :] for name in rows.columns if name.lower().startswith(start.lower())]
    flags = {
        start + name: F.coalesce((F.col(column) == level).cast("int"), F.lit(0))
        for level, name in list(zip(ordered, column_names(ordered, taken)))[1:]
    }
    return rows.withColumns(flags).drop(column)


def hash_bucket(*keys: Column, buckets: int = 100) -> Column:
    """Bucket of a row by its key values alone.

    MD5 of the joined text gives the same bucket on any partitioning, cluster
    or engine, which a random split does not.
    """
    text = F.concat_ws("|", *keys)
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_share(*keys: Column) -> Column:
    """Place of a row between 0 and ``HASH_SHARES`` by its key values alone, the same on any engine."""
    text = F.concat_ws("|", *(F.coalesce(key.cast("string"), F.lit("")) for key in keys))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


HASH_SHARES = 1 << 60
