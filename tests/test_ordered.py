"""The ordered table: the order comes from its files, and only the ranges asked for are read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from salesloom.plans.queries import LINE_KEYS
from salesloom.sources import ordered
from salesloom.sources.sales import sample_by_key
from salesloom.sources.star import star_sales

BY = [("a", False), ("b", True)]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    data = [(draw.choice([None, 1.5, draw.random() * 100]), draw.choice(["x", "y", None, "z"]), k) for k in range(5000)]
    return spark.createDataFrame(data, "a double, b string, k int")


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered") / "table")
    ordered.write_ordered(rows.repartition(5), path, BY, ranges=8)
    return path


def key(row):
    return (row.a is None, -(row.a or 0), row.b is not None, row.b or "")


def test_rows_come_in_order(spark, rows, path):
    found = list(ordered.rows_in_order(spark, path))
    assert sorted(r.k for r in found) == list(range(5000))
    assert [key(r) for r in found] == sorted(map(key, rows.collect()))


def test_bounds(spark, path):
    bounds = ordered.read_bounds(spark, path).collect()
    assert len(bounds) > 3 and sum(r.n_rows for r in bounds) == 5000
    assert max(r.n_rows for r in bounds) < 2500  # a third of the rows share 1.5, a third are null
    assert ordered.overlaps(spark, path) == 0


def test_first_rows_read_only_the_first_ranges(spark, rows, path):
    expected = sorted(map(key, rows.collect()))
    for n in (0, 1, 100, 4999, 6000):
        assert [key(r) for r in ordered.first_rows(spark, path, n).collect()] == expected[:n]
    few = ordered.first_rows(spark, path, 10)
    text = few._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part#\d+ = 0\)", text) and "Exchange" not in text


def test_rows_between(spark, rows, path):
    found = ordered.rows_between(spark, path, 20.0, 30.0)
    assert sorted(r.k for r in found.collect()) == sorted(r.k for r in rows.where(F.col("a").between(20.0, 30.0)).collect())
    assert ordered.rows_between(spark, path, 200.0, 300.0).count() == 0


def test_empty_table_and_taken_name(spark, rows, tmp_path):
    ordered.write_ordered(rows.limit(0), str(tmp_path / "none"), BY)
    assert list(ordered.rows_in_order(spark, str(tmp_path / "none"))) == []
    assert ordered.read_bounds(spark, str(tmp_path / "none")).count() == 0
    first = ordered.first_rows(spark, str(tmp_path / "none"), 5)
    assert first.columns == rows.columns and first.count() == 0
    assert ordered.rows_between(spark, str(tmp_path / "none"), 0.0, 9.0).count() == 0
    assert ordered.overlaps(spark, str(tmp_path / "none")) == 0
    with pytest.raises(ValueError, match="part"):
        ordered.write_ordered(rows.withColumn("Part", F.lit(1)), str(tmp_path / "clash"), BY)


def test_samples_nest(spark, tiny):
    keys = LINE_KEYS
    lines = star_sales(spark, tiny, (*keys, "price"))
    samples = [{tuple(r) for r in sample_by_key(lines, keys, f).collect()} for f in (0.0, 0.001, 0.1, 0.5, 1.0)]
    assert all(a <= b for a, b in zip(samples, samples[1:]))
    n = lines.count()
    assert not samples[0] and len(samples[-1]) == n
    assert 0 < len(samples[1]) < 0.004 * n and 0.08 * n < len(samples[2]) < 0.12 * n
    assert samples[2] == {tuple(r) for r in sample_by_key(lines.repartition(9), keys, 0.1).collect()}
    assert samples[2] != {tuple(r) for r in sample_by_key(lines, keys, 0.1, seed=5).collect()}
