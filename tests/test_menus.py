import pytest
from pyspark.sql import functions as F

from salesloom.functions.fixed_values import MENUS
from salesloom.operators.menus import menu_slice, menu_top, menus_on_sale, sales_by_menu_rated
from salesloom.operators.summaries import sales_cube
from salesloom.sources.dimensions import menu_table


def sale(subcategory, menu, price):
    return {"item_subcategory": subcategory, "menu_type": menu, "price": price}


def test_menu_table(spark):
    assert [tuple(row) for row in menu_table(spark).collect()] == list(MENUS)


def test_empty_menu_table_leaves_all_unmatched(spark, facts):
    row = sales_by_menu_rated(facts(sale("s", "Tacos", 1.0)), menu_table(spark, ())).first()
    assert (row.total, row.image, row.rating) == (1.0, None, None)


def test_unmatched_and_null_menus_stay(spark, facts):
    sales = facts(sale("s", "Tacos", 1.0), sale("s", "Unknown", 2.0), sale("s", None, 4.0))
    rows = {row.menu_type: (row.total, row.rating) for row in sales_by_menu_rated(sales, menu_table(spark)).collect()}
    assert rows == {"Tacos": (1.0, 4.5), "Unknown": (2.0, None), None: (4.0, None)}


def test_same_as_joining_every_order_line(spark, facts):
    menus = menu_table(spark, [("a", 4.0, "x"), ("a", 2.0, "x"), ("a", 5.0, "y"), ("b", None, "z"), ("b", 3.0, "z")])
    sales = facts(*(sale("s", menu, price) for menu, price in [("a", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), ("c", 8.0)]))
    plain = (
        sales.join(menus, "menu_type", "left")
        .groupBy("item_subcategory", "menu_type", "image")
        .agg(F.sum("price").alias("total"), F.avg("rating").alias("rating"))
    )
    key = lambda row: (row.menu_type, row.image, row.total, row.rating)
    expected = sorted(map(key, plain.collect()), key=repr)
    for rows in (sales, sales_cube(sales)):
        assert sorted(map(key, sales_by_menu_rated(rows, menus).collect()), key=repr) == expected


def test_top_breaks_ties_by_name_and_leaves_null_out(spark, facts):
    sales = facts(*(sale("s", menu, 5.0) for menu in "dbca"), sale("s", "e", 6.0), sale(None, "a", 99.0))
    top = menu_top(sales_by_menu_rated(sales, menu_table(spark)))
    assert [(row.menu_type, row.place) for row in top.orderBy("place").collect()] == [("e", 1), ("a", 2), ("b", 3)]


@pytest.mark.parametrize("subcategory, menus", [("Hot Option", ["a"]), ("Cold Option", ["b"]), ("Warm Option", [])])
def test_slice(spark, facts, subcategory, menus):
    sales = facts(sale("Hot Option", "a", 5.0), sale("Cold Option", "b", 5.0))
    part = menu_slice(menu_top(sales_by_menu_rated(sales, menu_table(spark))), subcategory)
    assert "item_subcategory" not in part.columns
    assert [row.menu_type for row in part.collect()] == menus


def test_menus_on_sale(spark, facts):
    found = menus_on_sale(facts(sale("s", "Tacos", 1.0), sale("s", "Tacos", 1.0), sale("s", "?", 1.0)), menu_table(spark))
    assert {row.menu_type: row.rating for row in found.collect()} == {"Tacos": 4.5, "?": None}
