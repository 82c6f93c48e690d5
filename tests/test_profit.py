import datetime as dt

from salesloom.functions.calendar import with_calendar
from salesloom.operators.profit import (
    by_profit,
    item_cards,
    item_season_profit,
    top_item_season_series,
    top_items,
    top_items_sql,
)

MONTH = {"Winter": 1, "Spring": 4, "Summer": 7, "Autumn": 10}


def sale(item, season, unit_price, cost=1.0, price=10.0, category="Main", city="Warsaw"):
    return {
        "menu_item_name": item,
        "order_ts": dt.datetime(2022, MONTH[season], 5) if season else None,
        "unit_price": unit_price,
        "cost_of_goods_usd": cost,
        "price": price,
        "item_category": category,
        "city": city,
    }


def profits(facts, *rows):
    return item_season_profit(with_calendar(facts(*rows)))


def test_profit_is_price_less_cost(facts):
    row = profits(facts, sale("x", "Summer", 5.0), sale("x", "Summer", 8.0, cost=2.0)).first()
    assert (row.unit_price, row.avg_cost, row.profit, row.total_sales) == (6.5, 1.5, 5.0, 20.0)


def test_seasons_count_alike_whatever_they_sold(facts):
    rows = profits(facts, *[sale("x", "Summer", 10.0)] * 9, sale("x", "Winter", 20.0))
    for top in (top_items(rows), top_items_sql(rows)):
        row = top.first()
        assert (row.unit_price, row.avg_cost, row.total_profit) == (15.0, 1.0, 14.0)


def test_top_items_by_profit_then_name(facts):
    rows = profits(facts, *(sale(item, "Summer", 5.0) for item in "dcba"), sale("z", "Summer", 9.0))
    for top in (top_items(rows), top_items_sql(rows)):
        assert [row.menu_item_name for row in top.collect()] == ["z", "a", "b"]


def test_order_by_profit(facts):
    rows = by_profit(profits(facts, sale("a", "Summer", 5.0), sale("b", "Summer", 9.0), sale("c", "Winter", 7.0)))
    assert [row.menu_item_name for row in rows.collect()] == ["b", "c", "a"]


def test_series_runs_from_spring_and_skips_unsold_seasons(facts):
    rows = profits(
        facts,
        sale("x", "Winter", 5.0, price=1.0),
        sale("x", "Spring", 5.0, price=2.0),
        sale("x", "Autumn", 5.0, price=4.0, city="Krakow"),
        sale("x", "Autumn", 5.0, price=8.0),
        sale("x", None, 5.0, price=99.0),
    )
    series = [(row.season, row.total_sales) for row in top_item_season_series(rows).collect()]
    assert series == [("Spring", 2.0), ("Autumn", 12.0), ("Winter", 1.0)]


def test_series_adds_up_an_item_over_its_categories(facts):
    rows = profits(
        facts,
        sale("x", "Summer", 9.0, price=1.0, category="Main"),
        sale("x", "Summer", 8.0, price=2.0, category="Snack"),
        sale("y", "Summer", 2.0, price=4.0),
    )
    series = [tuple(row) for row in top_item_season_series(rows, 2).collect()]
    assert series == [("x", "Main", "Summer", 3.0), ("x", "Snack", "Summer", 3.0)]


def test_season_sold_without_prices_is_zero(facts):
    rows = profits(facts, sale("x", "Summer", 9.0, price=None))
    assert [row.total_sales for row in top_item_season_series(rows).collect()] == [0.0]


def test_cards(facts):
    card = item_cards(top_items(profits(facts, sale("x", "Summer", 1234.5, cost=2000.25)))).first()
    assert (card.unit_price_text, card.cost_text, card.profit_text) == ("$ 1234.50", "$ 2000.25", "$ -765.75")
