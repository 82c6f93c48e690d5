import datetime as dt

import pytest
from pyspark.sql import functions as F

from salesloom.functions.calendar import daypart_ordinal, season_ordinal, week_end, with_calendar


def test_dayparts_at_their_edges(facts):
    hours = {4: "Night", 5: "Morning", 11: "Morning", 12: "Afternoon", 16: "Afternoon", 17: "Evening", 20: "Evening", 21: "Night"}
    sales = facts(*({"order_ts": dt.datetime(2022, 1, 1, hour, 59), "price": float(hour)} for hour in hours))
    got = {int(row.price): row.time_of_day for row in with_calendar(sales).collect()}
    assert got == hours


def test_seasons_at_their_edges(facts):
    months = {
        1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer",
        7: "Summer", 8: "Summer", 9: "Autumn", 10: "Autumn", 11: "Autumn", 12: "Winter",
    }
    sales = facts(*({"order_ts": dt.datetime(2022, month, 28), "price": float(month)} for month in months))
    got = {int(row.price): row.season for row in with_calendar(sales).collect()}
    assert got == months


def test_null_timestamp_is_night_without_season(facts):
    row = with_calendar(facts({"order_ts": None})).first()
    assert (row.time_of_day, row.season, row.date) == ("Night", None, None)


def test_calendar_replaces_the_timestamp(facts):
    assert "order_ts" not in with_calendar(facts({})).columns


@pytest.mark.parametrize(
    "day, sunday",
    [("2022-06-18", "2022-06-19"), ("2022-06-19", "2022-06-19"), ("2022-06-20", "2022-06-26")],
)
def test_week_ends_on_sunday(spark, day, sunday):
    frame = spark.createDataFrame([(day,)], "d string")
    assert str(frame.select(week_end(F.to_date("d"))).first()[0]) == sunday


def test_ordinals_and_unknown_values(spark):
    frame = spark.createDataFrame(
        [("Spring", "Morning"), ("Winter", "Night"), ("Rainy", "Noon"), (None, None)], "s string, t string"
    )
    rows = frame.select(season_ordinal(F.col("s")), daypart_ordinal(F.col("t"))).collect()
    assert [tuple(row) for row in rows] == [(1, 1), (4, 4), (None, None), (None, None)]
