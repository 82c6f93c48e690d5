"""Calendar columns of an order timestamp, all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.fixed_values import (
    DAYPART_HOURS,
    DAYPART_ORDER,
    NIGHT,
    SEASON_ORDER,
    SEASONS_FROM_DECEMBER,
)


def season(ts: Column) -> Column:
    """Season name; null for a null timestamp.

    ``try_element_at``, because ``element_at`` in ANSI mode is typed as never null
    here and would turn a null position into some season.
    """
    quarter_from_december = F.floor(F.month(ts) % 12 / 3).cast("int")
    return F.try_element_at(F.array(*map(F.lit, SEASONS_FROM_DECEMBER)), quarter_from_december + 1)


def daypart(ts: Column) -> Column:
    """Part of the day; a null timestamp counts as night."""
    hour = F.hour(ts)
    name = reduce(
        lambda case, part: case.when(hour.between(part[1], part[2] - 1), part[0]), DAYPART_HOURS, F
    )
    return name.otherwise(NIGHT)


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """Position of ``value`` in ``order``, from 1; null when it is not there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0).cast("long")).cast("int")


def season_ordinal(value: Column) -> Column:
    return ordinal(value, SEASON_ORDER)


def daypart_ordinal(value: Column) -> Column:
    return ordinal(value, DAYPART_ORDER)


def week_end(date: Column) -> Column:
    """The Sunday that ends the date's week; a Sunday is its own week end."""
    return F.next_day(F.date_sub(date, 1), "SUN")


def new_year(year: int) -> Column:
    """First moment of a year."""
    return F.make_timestamp_ntz(*(F.lit(part) for part in (year, 1, 1, 0, 0, 0)))


def within_years(ts: Column, first: int, last: int) -> Column:
    """Rows of the years ``first`` to ``last``, as a plain range on the timestamp.

    ``year(ts)`` in a filter cannot be compared with Parquet statistics; the
    half-open range can, so row groups of other years are skipped.
    """
    return (ts >= new_year(first)) & (ts < new_year(last + 1))


def with_date(sales: DataFrame) -> DataFrame:
    """``sales`` with a ``date`` column, derived from ``order_ts`` unless present."""
    return sales if "date" in sales.columns else sales.withColumn("date", F.col("order_ts").cast("date"))


def with_calendar(sales: DataFrame) -> DataFrame:
    """``sales`` with date, time of day and season in place of ``order_ts``."""
    ts = F.col("order_ts")
    return sales.withColumns(
        {"date": ts.cast("date"), "time_of_day": daypart(ts), "season": season(ts)}
    ).drop("order_ts")
