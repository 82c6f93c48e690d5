import datetime as dt
import math
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from salesloom.operators import forecast

FIRST = dt.date(2020, 1, 5)


def weeks(spark, values, category="a"):
    rows = [(FIRST + dt.timedelta(weeks=i), category, float(y)) for i, y in enumerate(values)]
    return spark.createDataFrame(rows, "week_end date, item_category string, y double")


def yearly(days):
    return math.sin(2 * math.pi * days / 365.25)


def test_recovers_line_and_season(spark):
    def truth(ds):
        days = (ds - FIRST).days
        return 1000 + 0.8 * days + 200 * yearly(days)

    series = weeks(spark, [truth(FIRST + dt.timedelta(weeks=i)) for i in range(160)])
    rows = forecast.category_forecast(series).collect()
    errors = [abs(row.y - truth(row.ds)) for row in rows]
    assert len(rows) == 160 + 365
    assert max(errors) < 0.03 * 1000


def test_follows_a_bend_in_the_trend(spark):
    values = [10.0 * i if i < 80 else 800.0 - 5.0 * (i - 80) for i in range(160)]
    series = weeks(spark, values)
    fitted = forecast.category_forecast(series)
    actual = series.join(fitted.withColumnRenamed("y", "fit"), F.col("week_end") == F.col("ds"))
    assert actual.select(F.max(F.abs(F.col("y") - F.col("fit")))).first()[0] < 60
    last = fitted.orderBy(F.desc("ds")).first()
    assert last.y < values[-1]


@pytest.mark.parametrize("rounds", [500, 2, 0])
def test_solution_is_a_minimum_of_the_posterior(rounds):
    """No small step in any direction makes the fitted parameters more probable, whichever solver found them."""
    draw = np.random.default_rng(3)
    day = 18000 + 7 * np.arange(120)
    y = 500 + np.where(day < 18400, 2.0, -1.0) * (day - 18400) + 60 * np.sin(day / 58.0) + draw.normal(0, 20, 120)
    row = forecast.series_fitter(rounds)(("a",), pd.DataFrame({"day": day, "y": y})).iloc[0]
    assert row.converged
    scale, span = np.abs(y).max(), day[-1] - day[0]
    angle = 2 * np.pi / 365.25 * np.outer(day, np.arange(1, 11))
    design = np.column_stack(
        [np.ones(120), (day - day[0]) / span, np.maximum(day[:, None] - row.knots, 0) / span, np.sin(angle), np.cos(angle)]
    )
    best = np.r_[row.level, row.slope * span, row.bends * span, row.sines, row.cosines] / scale
    changes = slice(2, 2 + len(row.knots))

    def loss(w):
        rss = np.square(y / scale - design @ w).sum()
        noise = (math.sqrt(120**2 + 16 * rss) - 120) / 8
        priors = np.square(w[:2]).sum() / 50 + np.abs(w[changes]).sum() / 0.05 + np.square(w[changes.stop :]).sum() / 200
        return 60 * math.log(noise) + rss / (2 * noise) + 2 * noise + priors

    assert len(row.knots) == 25
    for i in range(len(best)):
        for step in (1e-3, -1e-3):
            moved = best.copy()
            moved[i] += step
            assert loss(moved) > loss(best) - 1e-6


def test_both_solvers_agree():
    draw = np.random.default_rng(6)
    for n in (4, 30, 53, 160, 340):
        day = 18000 + 7 * np.arange(n)
        kinds = [draw.normal(100, 10, n), 5.0 * np.arange(n) ** 1.2, draw.integers(0, 2, n) * 50.0, np.r_[np.zeros(n - 1), 9.0]]
        for y in kinds:
            series = pd.DataFrame({"day": day, "y": y})
            first, second = (forecast.series_fitter(rounds)(("a",), series).iloc[0] for rounds in (500, 1))
            assert second.solver == "proximal" and second.converged
            at = np.arange(day[0], day[-1] + 100)

            def predicted(row, at=at):
                angle = 2 * np.pi / 365.25 * np.outer(at, np.arange(1, 11))
                bent = np.maximum(at[:, None] - np.array(row.knots), 0) @ row.bends if len(row.knots) else 0
                return row.level + row.slope * (at - row.first_day) + bent + np.sin(angle) @ row.sines + np.cos(angle) @ row.cosines

            if first.converged:
                assert np.abs(predicted(first) - predicted(second)).max() < 1e-3 * max(np.abs(y).max(), 1)


def test_forecasts_tell_whether_they_converged(spark):
    series = weeks(spark, [float(k % 7 + k) for k in range(60)])
    assert {row.converged for row in forecast.category_forecast(series).collect()} == {True}
    both = forecast.actual_vs_forecast(series)
    assert {(row.type, row.converged) for row in both.collect()} == {("Actual", None), ("Forecast", True)}


@pytest.mark.parametrize("value", [0.0, 7.5])
def test_constant_series_stays_constant(spark, value):
    rows = forecast.category_forecast(weeks(spark, [value] * 30)).collect()
    assert len(rows) == 30 + 365
    assert all(row.y == pytest.approx(value) for row in rows)


def test_one_week_has_no_forecast(spark):
    series = weeks(spark, [5.0]).union(weeks(spark, [1.0, 2.0, 3.0], "b"))
    both = forecast.actual_vs_forecast(series)
    counts = {(row.item_category, row.type): row["count"] for row in both.groupBy("item_category", "type").count().collect()}
    assert counts == {("a", "Actual"): 1, ("b", "Actual"): 3, ("b", "Forecast"): 3 + 365}


def test_short_series_are_finite(spark):
    for n in (2, 3, 5):
        rows = forecast.category_forecast(weeks(spark, range(1, n + 1))).collect()
        assert len(rows) == n + 365 and all(math.isfinite(row.y) for row in rows)


def test_dates_are_the_calendar(spark):
    series = weeks(spark, [1.0, 4.0, 2.0, 8.0])
    for periods, step in ((365, 1), (52, 7)):
        calendar = {row.ds for row in forecast.forecast_calendar(series, periods, step).collect()}
        predicted = [row.ds for row in forecast.category_forecast(series, periods, step).collect()]
        last = FIRST + dt.timedelta(weeks=3)
        future = {last + dt.timedelta(days=step * k) for k in range(1, periods + 1)}
        assert calendar == set(predicted) == future | {FIRST + dt.timedelta(weeks=i) for i in range(4)}
        assert len(predicted) == 4 + periods


def test_null_category_has_its_own_model(spark):
    series = weeks(spark, [1.0, 3.0, 2.0], None)
    rows = forecast.category_forecast(series).collect()
    assert len(rows) == 3 + 365 and {row.item_category for row in rows} == {None}


def test_trend_is_the_least_squares_line(spark):
    row = forecast.category_trend(weeks(spark, [3.0, 5.0, 7.0, 9.0])).first()
    week_zero = (FIRST - dt.date(1970, 1, 4)).days // 7
    assert (row.n_weeks, row.slope) == (4, pytest.approx(2.0))
    assert row.intercept + row.slope * week_zero == pytest.approx(3.0)


def test_registered_forecast_has_all_rows(spark, tiny):
    from salesloom.plans.queries import QUERIES

    per_category = (
        QUERIES["weekly_category_sales"](spark, tiny).groupBy("item_category").agg(F.count("y").alias("n"))
    )
    expected = {row.item_category: 2 * row.n + 365 for row in per_category.collect()}
    both = QUERIES["actual_vs_forecast"](spark, tiny)
    assert {row.item_category: row["count"] for row in both.groupBy("item_category").count().collect()} == expected


def test_workers_need_no_copy_of_the_package(tmp_path):
    sent = cloudpickle.dumps(forecast.series_fitter())
    script = (
        "import pickle, sys, pandas as pd\n"
        "fit = pickle.loads(sys.stdin.buffer.read())\n"
        "row = fit(('a',), pd.DataFrame({'day': [18000, 18007, 18014], 'y': [1.0, 2.0, 3.0]}))\n"
        "print(len(row), 'salesloom' in sys.modules)\n"
    )
    done = subprocess.run([sys.executable, "-c", script], input=sent, capture_output=True, cwd=tmp_path, check=True)
    assert done.stdout.split() == [b"1", b"False"]
