"""Inputs that are off: null categories, odd names, orphan lines, ties of rounding."""

import datetime as dt

import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesloom.functions.encoding import one_hot
from salesloom.functions.labels import plain_money
from salesloom.functions.names import column_names, value_of
from salesloom.operators import forecast, options, profit, summaries, weekly
from salesloom.sources.sales import ALL_COLUMNS
from salesloom.sources.star import star_sales


def test_pivot_and_back_keep_every_sale(facts):
    sold = [(None, 10.0), ("Dr. Pepper", 5.0), ("Main", 2.5)]
    days = [dt.datetime(2022, 1, 3), dt.datetime(2022, 1, 12), dt.datetime(2022, 1, 30)]
    sales = facts(*({"item_category": c, "price": p, "order_ts": d} for c, p in sold for d in days))
    daily = summaries.daily_category_sales(sales)
    levels = options.levels(daily, "item_category")
    assert levels == ["Dr. Pepper", "Main", None]
    wide = summaries.daily_category_pivot(daily, levels)
    assert [tuple(row)[1:] for row in wide.orderBy("date").collect()] == [(5.0, 2.5, 10.0)] * 3
    long = weekly.weekly_category_sales(sales)
    again = weekly.weekly_long(weekly.weekly_wide(long, options.levels(long, "item_category")))
    assert sorted(map(str, again.select(*long.columns).collect())) == sorted(map(str, long.collect()))


def test_odd_categories_make_the_round_trip(facts):
    """Names that clash with the result's own columns, with the missing one's or with each other but for case."""
    names = [None, "null", "week_end", "date", "WEEK_END", "Dr. Pepper", "a`b", "=main", "Main", "main", "MAIN", "", "ß", "ss", "%41"]
    days = [dt.datetime(2022, 1, 3), dt.datetime(2022, 1, 12), dt.datetime(2022, 1, 30)]
    sales = facts(*({"item_category": c, "price": float(k), "order_ts": d} for k, c in enumerate(names) for d in days))
    long = weekly.weekly_category_sales(sales)
    levels = options.levels(long, "item_category")
    assert set(levels) == set(names)
    wide = weekly.weekly_wide(long, levels)
    assert len({name.lower() for name in wide.columns}) == len(names) + 1
    again = weekly.weekly_long(wide)
    assert sorted(map(str, again.select(*long.columns).collect())) == sorted(map(str, long.collect()))
    daily = summaries.daily_category_sales(sales)
    pivot = summaries.daily_category_pivot(daily, levels)
    for row in pivot.collect():
        assert {value_of(name): row[name] for name in pivot.columns if name != "date"} == {c: float(k) for k, c in enumerate(names)}
    flags = one_hot(daily, "item_category", [name for name in levels if name is not None])
    assert len({name.lower() for name in flags.columns}) == 2 + len(names) - 2
    assert flags.count() == daily.count()


@given(st.lists(st.one_of(st.none(), st.text(max_size=5), st.sampled_from(["null", "A", "a", "=a", "%", "k", "K"])), unique=True), st.sets(st.text(max_size=3)))
def test_names_tell_their_values(values, taken):
    names = column_names(values, taken)
    assert [value_of(name) for name in names] == values
    folded = [name.upper().lower() for name in names]
    assert len(set(folded)) == len(names)
    assert not {name.upper().lower() for name in taken} & set(folded)


def test_plain_money_rounds_to_even_and_keeps_null(spark):
    frame = spark.createDataFrame([(2.675,), (0.125,), (1234.5,), (None,)], "v double")
    assert [row[0] for row in frame.select(plain_money(F.col("v"))).collect()] == ["$ 2.67", "$ 0.12", "$ 1234.50", None]


def test_nan_profit_ranks_last(spark):
    rows = [("a", "c", 1.0, 3.0, 2.0), ("b", "c", 1.0, float("nan"), float("nan")), ("d", "c", None, None, None)]
    frame = spark.createDataFrame(rows, "menu_item_name string, item_category string, avg_cost double, unit_price double, profit double")
    for top in (profit.top_items(frame, 3), profit.top_items_sql(frame, 3)):
        assert [row.menu_item_name for row in top.collect()] == ["a", "b", "d"]


def test_lines_do_not_depend_on_the_columns(spark, tiny, tmp_path):
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet")
    orphan = lines.limit(1).withColumns({k: F.lit(-5).cast(lines.schema[k].dataType) for k in ("l_orderkey", "l_partkey", "l_suppkey")})
    lines.union(orphan).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("orders", "part", "supplier", "nation"):
        table = spark.read.parquet(f"{tiny}/{name}.parquet")
        if name == "part":
            table = table.withColumn("p_name", F.expr("if(p_partkey % 7 = 0, 'oneword', p_name)"))
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    counts = {star_sales(spark, str(tmp_path), (name,)).count() for name in ALL_COLUMNS}
    assert counts == {lines.count() + 1}
    assert star_sales(spark, str(tmp_path)).where("item_category = ''").count() > 0


def test_fit_tells_whether_it_converged(spark):
    rows = [(dt.date(2020, 1, 5) + dt.timedelta(weeks=k), "a", 7.0) for k in range(120)]
    rows += [(dt.date(2020, 1, 5), "short", 3.0)]
    frame = spark.createDataFrame(rows, "week_end date, item_category string, y double")
    models = {row.item_category: row for row in forecast.category_models(frame).collect()}
    assert models["a"].converged and models["short"].level is None
    series = pd.DataFrame({"day": range(0, 840, 7), "y": [float(k % 9 + k) for k in range(120)]})
    assert not forecast.series_fitter(rounds=2, steps=0)(("a",), series).iloc[0].converged
    assert forecast.series_fitter(rounds=2)(("a",), series).iloc[0].converged
    shown = {row.item_category: row for row in forecast.forecast_fits(frame).collect()}
    assert (shown["a"].n_weeks, shown["a"].solver, shown["a"].converged) == (120, "reweighted", True)
    assert (shown["short"].n_weeks, shown["short"].converged) == (1, None)
    both = forecast.actual_vs_forecast(frame)
    counts = {tuple(row)[:2]: row["count"] for row in both.groupBy("item_category", "type").count().collect()}
    assert counts == {("a", "Actual"): 120, ("a", "Forecast"): 120 + 365, ("short", "Actual"): 1}
