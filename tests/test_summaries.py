import datetime as dt

from salesloom.functions.labels import clean_text, option_icon, option_type, plain_money
from salesloom.operators import summaries
from pyspark.sql import functions as F

DAY = dt.datetime(2022, 6, 15, 13)


def test_option_type_by_word_in_the_name(spark):
    names = ["Hot Option", "Cold Option", "Warm Option", "hot cold", "cold hot", "SHOT", "iced", None]
    frame = spark.createDataFrame([(name,) for name in names], "n string")
    kinds = [row[0].split()[0] for row in frame.select(option_type(F.col("n"))).collect()]
    assert kinds == ["Hot", "Cold", "Warm", "Hot", "Hot", "Hot", "Warm", "Warm"]


def test_icons(spark):
    frame = spark.createDataFrame([("Hot Option",), ("Cold Option",), ("Warm Option",), ("other",)], "k string")
    assert [row[0] for row in frame.select(option_icon(F.col("k"))).collect()] == ["🌶️", "🍦", "🍜", ""]


def test_money_text(spark, facts):
    sales = facts({"price": 1234567.25}, {"price": 0.5})
    card = summaries.subcategory_cards(summaries.subcategory_summary(sales)).first()
    assert (card.total_text, card.avg_text) == (f"$ {1234567.75:,.0f}", f"$ {617283.875:,.2f}")
    amounts = [1234.5, -0.126, 7.0]
    frame = spark.createDataFrame([(a,) for a in amounts], "a double")
    texts = [row[0] for row in frame.select(plain_money(F.col("a"))).collect()]
    assert texts == [f"$ {a:.2f}" for a in amounts]


def test_top_subcategories_break_ties_by_name(facts):
    sales = facts(*({"item_subcategory": name, "price": 5.0} for name in "dcba"), {"item_subcategory": None, "price": 99.0})
    top = summaries.top_subcategories(summaries.subcategory_summary(sales))
    assert [row.item_subcategory for row in top.collect()] == ["a", "b", "c"]


def test_null_prices_count_in_neither_mean_nor_sum(facts):
    sales = facts({"price": 4.0}, {"price": None}, {"price": 8.0})
    for rows in (sales, summaries.sales_cube(sales)):
        row = summaries.subcategory_summary(rows).first()
        assert (row.avg_spending, row.total_sales) == (6.0, 12.0)


def test_daily_series_holds_the_best_only(facts):
    sales = facts(
        *({"item_subcategory": name, "price": float(price)} for name, price in zip("abcd", (1, 2, 3, 4))),
        {"item_subcategory": "d", "price": 6.0, "order_ts": DAY - dt.timedelta(days=1)},
        {"item_subcategory": "d", "price": 1.0, "order_ts": DAY - dt.timedelta(hours=13)},
    )
    series = [(row.item_subcategory, row.date.day, row.daily_total) for row in summaries.top_daily_series(sales).collect()]
    assert series == [("b", 15, 2.0), ("c", 15, 3.0), ("d", 14, 6.0), ("d", 15, 5.0)]


def test_pivot_fills_zero(facts):
    sales = facts({"item_category": "x", "price": 1.0}, {"item_category": "y", "order_ts": DAY + dt.timedelta(days=1)})
    wide = summaries.daily_category_pivot(summaries.daily_category_sales(sales), ["x", "y"]).orderBy("date")
    assert [(row.x, row.y) for row in wide.collect()] == [(1.0, 0.0), (0.0, 10.0)]


def test_clean_text_drops_broken_bytes_only(spark):
    rows = [(b"caf\xc3\xa9",), (b"ab\xff\xc3cd",), ("kept \ufffd".encode(),), (None,)]
    frame = spark.createDataFrame([(bytearray(row[0]) if row[0] else None,) for row in rows], "b binary")
    texts = frame.select(clean_text(F.col("b").cast("string"))).collect()
    assert [row[0] for row in texts] == ["café", "abcd", "kept \ufffd", None]
