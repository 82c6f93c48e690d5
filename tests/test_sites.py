import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from salesloom.functions.calendar import with_calendar
from salesloom.functions.encoding import one_hot
from salesloom.functions.fixed_values import CITY_CENTERS, DEFAULT_CENTER, RING_DEGREES
from salesloom.operators import profit, sites
from salesloom.plans.hotspots import Hotspots
from salesloom.sources.dimensions import city_table


@pytest.fixture(scope="module")
def sales(facts):
    """Sales that grow to the north, in two categories and all seasons and dayparts."""
    draw = random.Random(5)
    rows = []
    for i in range(600):
        lat = 52.2 + draw.randrange(60) / 1000
        category = draw.choice(["Main", "Snack"])
        rows.append(
            {
                "latitude": lat,
                "longitude": 21.0 + draw.randrange(20) / 1000,
                "item_category": category,
                "order_ts": dt.datetime(2022, 1 + i % 12, 3, i % 24),
                "price": 100 + 5000 * (lat - 52.2) + (200 if category == "Main" else 0) + draw.random(),
            }
        )
    return facts(*rows)


@pytest.fixture(scope="module")
def locations(sales):
    return sites.location_sales(with_calendar(sales))


@pytest.fixture(scope="module")
def model(locations):
    return sites.fit_site_model(locations, trees=20)


def test_order_of_locations(facts):
    rows = facts({"latitude": 1.0}, {"latitude": 2.0, "longitude": 1.0}, {"latitude": 2.0, "longitude": 3.0})
    ordered = sites.north_to_south(sites.location_sales(with_calendar(rows))).collect()
    assert [(row.latitude, row.longitude) for row in ordered] == [(2.0, 3.0), (2.0, 1.0), (1.0, 21.0)]


def test_bounds(facts):
    rows = facts({"price": 1.0}, {"price": 2.0}, {"price": 7.0, "latitude": 0.0})
    assert tuple(sites.sales_bounds(sites.location_sales(with_calendar(rows))).first()) == (3.0, 7.0)


def test_city_centers(spark):
    assert sites.center_of("Krakow") == CITY_CENTERS[1][1:]
    assert sites.center_of("Gdansk") == DEFAULT_CENTER
    cities = spark.createDataFrame([("Krakow",), ("Gdansk",)], "city string")
    rows = {row.city: (row.lat, row.lon) for row in sites.city_centers(cities, city_table(spark)).collect()}
    assert rows == {"Krakow": CITY_CENTERS[1][1:], "Gdansk": DEFAULT_CENTER}


def test_candidates_lie_in_their_rings(locations):
    rows = sites.candidate_sites(locations, "Tacos", (50.0, 20.0)).collect()
    assert len(rows) == 3 * 17 * 2
    for row in rows:
        reach = RING_DEGREES[row.ring] + 1e-12
        assert row.ring == row.site_id // 17
        assert abs(row.latitude - 50.0) <= reach and abs(row.longitude - 20.0) <= reach
    spots = {(row.latitude, row.longitude) for row in rows}
    assert len(spots) == 51
    assert len({(row.season, row.time_of_day) for row in rows}) == 16
    by_site = {}
    for row in rows:
        by_site.setdefault(row.site_id, set()).add((row.latitude, row.longitude, row.season, row.time_of_day))
    assert all(len(values) == 1 for values in by_site.values())


def test_candidates_draw_from_what_occurs(facts):
    rows = facts({"order_ts": dt.datetime(2022, 7, 1, 13)}, {"order_ts": dt.datetime(2022, 1, 1, 13)}, {"order_ts": None})
    drawn = sites.candidate_sites(sites.location_sales(with_calendar(rows)), "Tacos").collect()
    assert {row.season for row in drawn} == {"Summer", "Winter"}
    assert {row.time_of_day for row in drawn} == {"Afternoon", "Night"}


def test_one_hot_base_and_unknown(spark):
    frame = spark.createDataFrame([("a",), ("b",), ("c",), ("?",), (None,)], "k string")
    rows = [tuple(row) for row in one_hot(frame, "k", ["c", "a", "b"]).collect()]
    assert rows == [(0, 0), (1, 0), (0, 1), (0, 0), (0, 0)]


def test_split_depends_on_keys_alone(locations):
    def train(frame):
        rows = sites.with_split(frame).filter("split = 'train'").collect()
        return {tuple(row[key] for key in sites.LOCATION_KEYS) for row in rows}

    once, again = train(locations), train(locations.repartition(5))
    assert once == again
    assert 0.7 < len(once) / locations.count() < 0.9


def test_model_beats_the_mean(model, locations):
    rows = {row.split: row for row in sites.model_metrics(model, locations).collect()}
    assert rows["train"].n_rows + rows["test"].n_rows == locations.count()
    assert rows["test"].rmse < 0.7 * rows["test"].rmse_of_mean


def test_same_seed_same_scores(model, locations):
    candidates = sites.candidate_sites(locations, "Tacos")
    again = sites.fit_site_model(locations, trees=20)
    key = lambda row: (row.site_id, row.item_category)
    first, second = (sorted(sites.score_sites(m, candidates).collect(), key=key) for m in (model, again))
    assert [row.predicted_sales for row in first] == pytest.approx([row.predicted_sales for row in second])


def test_scores_keep_every_candidate_and_follow_the_data(model, locations):
    candidates = sites.candidate_sites(locations, "Tacos", (52.23, 21.01))
    scored = sites.score_sites(model, candidates)
    assert scored.columns == candidates.columns + ["predicted_sales"]
    assert scored.count() == candidates.count()
    north = F.col("latitude") > 52.23
    means = {row[0]: row[1] for row in scored.groupBy(north).agg(F.avg("predicted_sales")).collect()}
    assert means[True] > means[False]


def test_unseen_category_is_scored(model, locations):
    odd = sites.candidate_sites(locations, "Tacos").withColumn("item_category", F.lit("Never seen"))
    assert sites.score_sites(model, odd).filter("predicted_sales IS NULL").count() == 0


def test_rows_without_season_do_not_reach_the_model(locations):
    extra = locations.limit(1).withColumn("season", F.lit(None).cast("string")).withColumn("total_sales", F.lit(1e12))
    rows = {row.split: row.n_rows for row in sites.model_metrics(sites.fit_site_model(locations.union(extra), 2), locations.union(extra)).collect()}
    assert sum(rows.values()) == locations.count()


def test_hotspots_end_to_end(sales):
    with Hotspots(sales, "Tacos", "Warsaw", trees=5) as spots:
        assert spots.found() and spots.center == CITY_CENTERS[0][1:]
        points = spots.heat_points()
        assert points.columns == ["latitude", "longitude", "predicted_sales"]
        assert points.count() == 3 * 17 * 2
        assert spots.metrics().count() == 2
        cards = {(row.menu_item_name, row.item_category) for row in spots.top_item_cards().collect()}
        assert cards == {("Taco", "Main"), ("Taco", "Snack")}
        assert spots.season_series().count() == 2 * 4
    with Hotspots(sales, "Tacos", "Nowhere", categories=["Main"]) as spots:
        assert not spots.found()
        assert spots.model is None
        assert spots.heat_points().count() == 0 and spots.metrics().count() == 0


def test_shared_totals_are_those_of_the_sales(sales):
    with Hotspots(sales, "Tacos", "Warsaw") as spots:
        plain = profit.item_season_profit(spots.sales)
        key = lambda row: str(tuple(row)[:4])
        for found, expected in zip(sorted(spots.profits.collect(), key=key), sorted(plain.collect(), key=key), strict=True):
            assert tuple(found)[:4] == tuple(expected)[:4] and tuple(found)[4:] == pytest.approx(tuple(expected)[4:])
        total = sites.location_sales(spots.sales).agg(F.sum("total_sales"), F.count("*")).first()
        assert tuple(spots.locations.agg(F.sum("total_sales"), F.count("*")).first()) == pytest.approx(tuple(total))


def test_sites_of_chosen_categories(sales):
    with Hotspots(sales, "Tacos", "Warsaw", categories=["Main", "Unsold"]) as spots:
        counts = {row.item_category: row["count"] for row in spots.candidates().groupBy("item_category").count().collect()}
    assert counts == {"Main": 51, "Unsold": 51}


def test_sites_without_any_time(facts):
    rows = sites.location_sales(with_calendar(facts({"order_ts": None})))
    drawn = sites.candidate_sites(rows, "Tacos").collect()
    assert len(drawn) == 51 and {row.season for row in drawn} == {None}


def test_odd_places_and_null_categories_stay(facts):
    rows = facts(
        *({"latitude": 50.0 + k / 100, "item_category": None if k % 2 else "Main", "price": float(k)} for k in range(40)),
        {"latitude": 12345.0},
    )
    located = sites.location_sales(with_calendar(rows))
    assert sites.with_split(located).count() == 41
    model = sites.fit_site_model(located, trees=2)
    assert sum(row.n_rows for row in sites.model_metrics(model, located).collect()) == 41
    scored = sites.score_sites(model, sites.candidate_sites(located, "Tacos"))
    assert {row.item_category for row in scored.collect()} == {"Main", None}
    assert sum(row.n_rows for row in sites.split_stats(located).collect()) == 41
