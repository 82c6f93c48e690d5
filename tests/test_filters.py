import datetime as dt

import pytest

from salesloom.operators.filters import SalesFilter, at_location, has_rows
from salesloom.operators.options import distinct_values, levels, year_bounds

ROWS = (
    {"truck_brand_name": "All Day", "city": "Warsaw", "item_category": "Main", "price": 1.0},
    {"truck_brand_name": "Truck B", "city": "Krakow", "item_category": "Snack", "price": 2.0},
    {"truck_brand_name": None, "city": "Krakow", "item_category": "Drink", "price": 3.0},
)


def prices(frame):
    return sorted(row.price for row in frame.collect())


@pytest.mark.parametrize(
    "chosen, expected",
    [
        (SalesFilter(), [1.0, 2.0, 3.0]),
        (SalesFilter(brands="All"), [1.0, 2.0, 3.0]),
        (SalesFilter(categories=["All", "Main"]), [1.0, 2.0, 3.0]),
        (SalesFilter(brands="All Day"), [1.0]),
        (SalesFilter(categories=[]), []),
        (SalesFilter(cities="Krakow"), [2.0, 3.0]),
        (SalesFilter(cities=["Krakow"], categories=["Drink", "Main"]), [3.0]),
        (SalesFilter(brands=["Truck B", "All Day"]), [1.0, 2.0]),
    ],
)
def test_choices(facts, chosen, expected):
    assert prices(facts(*ROWS).transform(chosen)) == expected


@pytest.mark.parametrize(
    "menu, city, categories, expected",
    [
        ("Tacos", "Krakow", None, [2.0, 3.0]),
        ("Tacos", "Krakow", "All", [2.0, 3.0]),
        ("Tacos", "Krakow", "Drink", [3.0]),
        ("Tacos", None, None, []),
        (None, "Krakow", None, []),
        ("Ramen", "Krakow", None, []),
        ("Tacos", "Krakow", [], []),
    ],
)
def test_location(facts, menu, city, categories, expected):
    assert prices(facts(*ROWS).transform(at_location, menu, city, categories)) == expected


def test_years_are_inclusive(facts):
    moments = [
        dt.datetime(2020, 12, 31, 23, 59, 59, 999999),
        dt.datetime(2021, 1, 1),
        dt.datetime(2022, 12, 31, 23, 59, 59, 999999),
        dt.datetime(2023, 1, 1),
        None,
    ]
    sales = facts(*({"order_ts": ts, "price": float(i)} for i, ts in enumerate(moments)))
    assert prices(sales.transform(SalesFilter(years=(2021, 2022)))) == [1.0, 2.0]


def test_years_of_a_zoned_timestamp(facts):
    sales = facts({"order_ts": dt.datetime(2021, 1, 1)}, {"order_ts": dt.datetime(2020, 12, 31, 23)})
    zoned = sales.withColumn("order_ts", sales.order_ts.cast("timestamp"))
    assert zoned.transform(SalesFilter(years=(2021, 2021))).count() == 1


def test_distinct_values_keep_null(facts):
    found = distinct_values(facts(*ROWS), ("truck_brand_name", "city"))
    assert {tuple(row) for row in found.collect()} == {
        ("truck_brand_name", "All Day"),
        ("truck_brand_name", "Truck B"),
        ("truck_brand_name", None),
        ("city", "Warsaw"),
        ("city", "Krakow"),
    }


def test_single_year(facts):
    one = facts({"order_ts": dt.datetime(2021, 1, 1)}, {"order_ts": dt.datetime(2021, 12, 31, 23)})
    assert tuple(year_bounds(one).first()) == (2021, 2021, True)
    two = one.union(facts({"order_ts": dt.datetime(2022, 1, 1)}))
    assert tuple(year_bounds(two).first()) == (2021, 2022, False)


def test_levels_refuse_rather_than_drop(spark, facts):
    sales = facts(*ROWS)
    assert levels(sales, "item_category") == ["Drink", "Main", "Snack"]
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="more than 2"):
            levels(sales, "item_category")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_has_rows(facts):
    assert has_rows(facts(*ROWS))
    assert not has_rows(facts(*ROWS).filter("price > 99"))
