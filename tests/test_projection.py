import pytest

from salesloom.operators import forecast, menus, summaries, weekly
from salesloom.operators.filters import SalesFilter
from salesloom.plans.projection import SalesProjection
from salesloom.sources.dimensions import menu_table
from salesloom.sources.star import STAR_MENUS, star_sales

CHOSEN = SalesFilter(brands=["Brand#1", "Brand#2", "Brand#3"], years=(1996, 1999))


def same(left, right):
    assert left.columns == right.columns

    def rows(frame):
        return sorted((tuple(row) for row in frame.collect()), key=lambda row: [str(v) for v in row if not isinstance(v, float)])

    got, expected = rows(left), rows(right)
    assert len(got) == len(expected) > 0
    for found, wanted in zip(got, expected):
        for a, b in zip(found, wanted):
            assert a == (pytest.approx(b, rel=1e-9) if isinstance(b, float) else b)


def test_shared_aggregate_gives_the_same_results(spark, small):
    sales = star_sales(spark, small).transform(CHOSEN)
    table = menu_table(spark, STAR_MENUS)
    with SalesProjection(star_sales(spark, small), CHOSEN) as projection:
        same(projection.summary(), summaries.subcategory_summary(sales))
        same(projection.cards(), summaries.subcategory_cards(summaries.top_subcategories(summaries.subcategory_summary(sales))))
        same(projection.daily_series(), summaries.top_daily_series(sales))
        same(projection.weekly(), weekly.weekly_category_sales(sales))
        same(projection.trend(), forecast.category_trend(weekly.weekly_category_sales(sales)))
        same(projection.top_menus(table), menus.menu_top(menus.sales_by_menu_rated(sales, table)))
        assert projection.daily_pivot().count() == sales.select(sales.order_ts.cast("date")).distinct().count()
        n_weekly, n_categories = projection.weekly().count(), 8
        assert projection.forecast().count() == 2 * n_weekly + 365 * n_categories
        assert projection.cube.is_cached
    assert not projection.cube.is_cached
