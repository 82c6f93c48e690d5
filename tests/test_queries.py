"""Every registered query against its SQL form, over the whole tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as contract
from salesloom.plans.oracle import CATEGORIES
from salesloom.plans.oracle import ORACLE as SALES_ORACLE
from salesloom.plans.queries import QUERIES as SALES_QUERIES
from salesloom.operators.options import levels
from salesloom.sources.star import star_sales

QUERIES, ORACLE = SALES_QUERIES, SALES_ORACLE
MODELS = {"site_scores", "heat_points", "site_model_metrics"}


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(SALES_ORACLE))
def test_equals_sql(spark, small, connection, name):
    rows, differences = compare(QUERIES[name](spark, small), connection, ORACLE[name])
    assert rows > 0
    assert differences == []


def test_only_models_go_without_sql():
    without = MODELS | {"category_forecast", "actual_vs_forecast"}
    assert QUERIES.keys() - ORACLE.keys() == without
    assert ORACLE.keys() <= QUERIES.keys()
    assert contract.queries().items() >= QUERIES.items() and contract.oracle_sql().items() >= ORACLE.items()


def test_entry_has_rows(spark):
    assert contract.entry(spark).columns == ["week_end", "item_category", "y"]
    assert contract.entry(spark).count() > 0


def test_sql_lists_all_categories(spark, small):
    found = levels(star_sales(spark, small, ("item_category",)), "item_category")
    assert tuple(found) == CATEGORIES


def test_every_order_line_finds_its_dimensions(spark, small):
    """What allows the adapter to leave out joins that no column needs."""
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert star_sales(spark, small).count() == lines
