"""What the optimizer makes of the queries: scans, shuffles, joins and limits."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from salesloom.functions.calendar import with_calendar
from salesloom.operators import menus, options, profit, sites, summaries, weekly
from salesloom.operators.filters import SalesFilter, at_location
from salesloom.plans.queries import QUERIES
from salesloom.session import shared_folder, shuffle_settings, stored as stored_rows
from salesloom.sources.dimensions import menu_table
from salesloom.sources.sales import GEO_COLUMNS, SALES_COLUMNS, read_sales, sample_sales, write_result, write_sales
from salesloom.sources.star import bucket_star, star_sales

TRAINED = {"site_scores", "heat_points", "site_model_metrics", "site_score_check", "heat_points_check"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, tiny):
    """The facts as one wide Parquet table with upper-case column names."""
    path = str(tmp_path_factory.mktemp("facts") / "sales")
    sales = star_sales(spark, tiny)
    write_sales(sales.toDF(*(name.upper() for name in sales.columns)), path)
    return path


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def scan(frame) -> str:
    """The Parquet scan, with the filters and columns that reached it."""
    return re.search(r"FileScan parquet.*", plan(frame)).group(0)


def executed(frame) -> str:
    """The plan that ran, after adaptive changes."""
    frame.collect()
    return plan(frame)


def test_stored_table_keeps_rows_and_reads_in_lower_case(spark, stored, tiny):
    again = read_sales(spark, stored)
    assert again.columns == star_sales(spark, tiny).columns
    assert again.exceptAll(star_sales(spark, tiny)).count() == 0
    assert again.count() == spark.read.parquet(f"{tiny}/lineitem.parquet").count()


def test_column_lists(spark, stored):
    assert tuple(read_sales(spark, stored, SALES_COLUMNS).columns) == SALES_COLUMNS
    assert tuple(read_sales(spark, stored, GEO_COLUMNS).columns) == GEO_COLUMNS


def test_sample_is_repeatable_and_about_a_tenth(spark, stored):
    sales = read_sales(spark, stored)
    share = sample_sales(sales).count() / sales.count()
    assert 0.07 < share < 0.13
    assert sample_sales(sales).count() == sample_sales(sales).count()


def test_result_sink(spark, stored, tmp_path):
    summary = summaries.subcategory_summary(read_sales(spark, stored))
    write_result(summary, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == summary.count()


def test_filters_reach_the_scan(spark, stored):
    chosen = SalesFilter(brands=["Brand#1", "Brand#2"], cities="NATION_9", categories=["bolt"], years=(1996, 1998))
    line = scan(summaries.subcategory_summary(read_sales(spark, stored).transform(chosen)))
    assert "In(TRUCK_BRAND_NAME" in line or "In(truck_brand_name" in line
    assert re.search(r"EqualTo\(city,\s*NATION_9\)", line, re.I)
    assert re.search(r"EqualTo\(item_category,\s*bolt\)", line, re.I)
    assert re.search(r"GreaterThanOrEqual\(order_ts,1996-01-01", line, re.I)
    assert re.search(r"LessThan\(order_ts,1999-01-01", line, re.I)


def test_location_filter_reaches_the_scan(spark, stored):
    sales = with_calendar(read_sales(spark, stored, GEO_COLUMNS).transform(at_location, "PROMO", "NATION_9"))
    line = scan(sites.location_sales(sales))
    assert re.search(r"EqualTo\(menu_type,PROMO\)", line, re.I) and re.search(r"EqualTo\(city,NATION_9\)", line, re.I)


@pytest.mark.parametrize(
    "operator, columns",
    [
        (summaries.subcategory_summary, {"item_subcategory", "price"}),
        (summaries.daily_category_sales, {"item_category", "price", "order_ts"}),
        (weekly.weekly_totals, {"item_category", "price", "order_ts"}),
        (options.year_bounds, {"order_ts"}),
        (options.distinct_values, {"truck_brand_name", "city", "item_category", "menu_type"}),
    ],
)
def test_scan_reads_only_what_is_used(spark, stored, operator, columns):
    schema = re.search(r"ReadSchema: struct<(.*)>", scan(operator(read_sales(spark, stored)))).group(1)
    assert {field.split(":")[0].lower() for field in schema.split(",")} == columns


def test_totals_aggregate_before_their_shuffle(spark, stored):
    for operator in (summaries.subcategory_summary, summaries.sales_cube, weekly.weekly_totals):
        text = plan(operator(read_sales(spark, stored)))
        assert text.count("Exchange hashpartitioning") == 1
        assert text.index("Exchange") < text.index("partial_sum")


def test_weekly_sales_scan_the_facts_once(spark, stored):
    assert "ReusedExchange" in executed(weekly.weekly_category_sales(read_sales(spark, stored)))


def test_daily_series_scans_the_facts_once(spark, stored):
    assert "ReusedExchange" in executed(summaries.top_daily_series(read_sales(spark, stored)))


def test_top_lists_sort_no_whole_table(spark, stored):
    sales = with_calendar(read_sales(spark, stored))
    items = profit.item_season_profit(sales)
    for top in (profit.top_items(items), profit.top_items_sql(items), profit.top_item_season_series(items)):
        assert "TakeOrderedAndProject" in plan(top)
    rated = menus.sales_by_menu_rated(sales, menu_table(spark))
    assert "WindowGroupLimit" in plan(menus.menu_top(rated))


def test_menu_slice_filters_in_the_scan(spark, stored):
    rated = menus.sales_by_menu_rated(read_sales(spark, stored), menu_table(spark))
    assert re.search(r"EqualTo\(item_subcategory,hot\)", scan(menus.menu_slice(menus.menu_top(rated), "hot")), re.I)


def test_menu_join_meets_totals_not_order_lines(spark, stored):
    text = plan(menus.sales_by_menu_rated(read_sales(spark, stored), menu_table(spark)))
    assert text.index("BroadcastHashJoin") < text.rindex("partial_sum(price")


def test_bucketed_orders_meet_their_lines_without_a_shuffle(spark, tiny, tmp_path):
    tables = bucket_star(spark, tiny, str(tmp_path), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = ("order_key", "line_number", "order_ts", "price", "order_total")
        plain, bucketed = star_sales(spark, tiny, columns), star_sales(spark, tiny, columns, tables=tables)
        assert plan(plain).count("Exchange") == 2
        assert "SortMergeJoin" in plan(bucketed) and "Exchange" not in plan(bucketed)
        assert plan(bucketed).count("Bucketed: true") == 2
        assert sorted(bucketed.collect()) == sorted(plain.collect())
        assert len(list((tmp_path / tables["orders"]).glob("*.parquet"))) == 4
        of_years = star_sales(spark, tiny, columns, years=(1996, 1997), tables=tables)
        assert "Exchange" not in plan(of_years) and "GreaterThanOrEqual(o_orderdate" in plan(of_years)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in tables.values():
            spark.sql(f"DROP TABLE {name}")


def test_distinct_values_send_a_row_a_task(spark, stored):
    """However many lines a task reads, one row of sets leaves it."""
    sales = read_sales(spark, stored).repartition(6)
    found = options.distinct_values(sales)
    text = plan(found)
    assert text.index("hashpartitioning(task") < text.index("partial_collect_set")
    assert {tuple(row) for row in found.collect()} == {
        (name, row[0]) for name in options.OPTION_COLUMNS for row in sales.select(name).distinct().collect()
    }


def test_broadcasts_are_the_optimizers_choice(spark, tiny):
    """Without a threshold nothing is broadcast: no join insists on it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in sorted(QUERIES.keys() - TRAINED):
            assert "Broadcast" not in plan(QUERIES[name](spark, tiny)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_no_query_pairs_all_rows(spark, tiny):
    for name in sorted(QUERIES.keys() - TRAINED):
        text = plan(QUERIES[name](spark, tiny))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_python_runs_only_in_the_forecast(spark, tiny):
    for name in sorted(QUERIES.keys() - TRAINED):
        uses_python = re.search("InPandas|PythonUDF|ArrowEval|BatchEval", plan(QUERIES[name](spark, tiny)))
        assert bool(uses_python) == (name in {"category_forecast", "actual_vs_forecast", "actual_half", "forecast_check", "forecast_fits"}), name


def test_year_range_reaches_the_orders(spark, tiny):
    text = plan(QUERIES["filter_year_range"](spark, tiny))
    assert re.search(r"GreaterThanOrEqual\(o_orderdate,1995-12-31", text)
    assert re.search(r"LessThan\(o_orderdate,1999-01-01", text)


def test_hot_keys_give_whole_results(spark, facts):
    """A third of all rows under one key of every kind: nothing is lost or capped."""
    rows = [{"price": 1.0, "item_category": "hot" if i % 3 == 0 else f"c{i % 50}",
             "item_subcategory": "hot" if i % 3 == 0 else f"s{i % 20}",
             "order_ts": dt.datetime(2022, 1, 2) + dt.timedelta(days=0 if i % 3 == 0 else i % 90)} for i in range(3000)]
    sales = facts(*rows).repartition(16)
    totals = {row.item_subcategory: row.total_sales for row in summaries.subcategory_summary(sales).collect()}
    assert totals["hot"] == 1000.0 and sum(totals.values()) == 3000.0
    last_week = max(row["order_ts"] for row in rows).date()
    weeks = weekly.weekly_category_sales(sales)
    assert weeks.agg({"y": "sum"}).first()[0] == sum(
        1.0 for row in rows if row["order_ts"].date() <= last_week - dt.timedelta(days=(last_week.weekday() + 1) % 7 or 7)
    )


def test_hot_part_is_split_in_the_join(spark, small, tmp_path):
    """With a third of all order lines on one part, the join splits that part's partition."""
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    hot = lines.withColumn("l_partkey", F.expr("if(l_orderkey % 3 = 0, 7, l_partkey)"))
    hot.repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("orders", "part", "supplier", "nation"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    plain = {tuple(row) for row in QUERIES["subcategory_summary"](spark, str(tmp_path)).collect()}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        summary = QUERIES["subcategory_summary"](spark, str(tmp_path))
        assert {tuple(row) for row in summary.collect()} == plain
        assert "skew=true" in plan(summary)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_shuffle_settings_grow_with_the_input():
    small, large = shuffle_settings(10**9, 8), shuffle_settings(10**14, 8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(large["spark.sql.shuffle.partitions"]) == 10**14 // (512 * 1024 * 1024)


def test_stored_rows_lie_in_the_shared_folder_and_go(spark):
    with stored_rows(spark.range(10)) as rows:
        assert rows.count() == 10
        path = rows.inputFiles()[0]
        assert path.removeprefix("file://").startswith(shared_folder(spark).removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file://"))


@pytest.mark.parametrize("name", ["forecast_calendar", "actual_vs_forecast", "one_hot", "candidate_sites", "weekly_category_sales"])
def test_order_lines_are_read_once(spark, tiny, name):
    """By the rows that the stages read, whatever the plan says."""
    spark.catalog.clearCache()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"read-{name}", name)
    try:
        QUERIES[name](spark, tiny).write.format("noop").mode("overwrite").save()
        jobs = tracker.getJobIdsForGroup(f"read-{name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {stage for job in jobs for stage in (tracker.getJobInfo(job) or None).stageIds}
    read = 0
    for stage in stages:
        if tracker.getStageInfo(stage):
            attempts = store.stageData(stage, False, spark._jvm.java.util.ArrayList(), False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0))
            read += sum(attempts.apply(k).inputRecords() for k in range(attempts.size()))
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet").count()
    assert lines <= read < 1.5 * lines
