"""Forecast of weekly sales per category: piecewise-linear trend plus yearly season.

The additive model follows Taylor and Letham, "Forecasting at Scale" (2018):
slopes may change at up to 25 evenly spread weeks of the first 80 % of the
history, with a Laplace prior on each change, and the season is a Fourier
series of order 10. Spark groups and gap-fills the series; fitting one bounded
series is the only step in Python, and prediction is column arithmetic again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.fixed_values import FORECAST_DAYS

# Constants of the model.
CHANGEPOINTS = 25
CHANGEPOINT_SHARE = 0.8
CHANGE_SCALE = 0.05
TREND_VARIANCE = 25.0
SEASON_VARIANCE = 100.0
FOURIER_ORDER = 10
YEAR_DAYS = 365.25

MODEL_SCHEMA = (
    "item_category string, first_day int, last_day int, level double, slope double, "
    "knots array<int>, bends array<double>, sines array<double>, cosines array<double>, "
    "solver string, converged boolean, days array<int>, sold array<double>"
)


def series_fitter(rounds: int = 500, steps: int = 20_000) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The function that fits one category's series.

    It reweights least squares in so many rounds at most. A series that these leave open
    goes to a second solver, the proximal gradient in so many steps at most. ``solver``
    names the one whose result it is, ``converged`` tells whether that one came to an end.
    Of fewer than two weeks there is no model, only the weeks. Being local, the function
    travels to the workers by value: they need numpy and pandas, but no copy of this package.
    """

    def changes_solved(hessian, linear, weights, changes):
        """The exact minimum, found from the signs and zeros that the changes have now; None if these lead nowhere."""
        signs = np.zeros(len(weights))
        signs[changes] = np.sign(np.where(np.abs(weights) > 1e-9 * np.abs(weights).max(), weights, 0))[changes]
        free = np.ones(len(weights), dtype=bool)
        free[changes] = False
        most = (1 + 1e-9) / CHANGE_SCALE + 1e-12 * np.abs(linear).max()
        for _ in range(2 * len(weights)):
            active = free | (signs != 0)
            found = np.zeros(len(weights))
            found[active] = np.linalg.solve(hessian[np.ix_(active, active)], (linear - signs / CHANGE_SCALE)[active])
            turned = found * signs < 0
            slack = np.where(active, 0, linear - hessian @ found)
            if turned.any():
                signs[turned] = 0  # it passed zero, where it stays
            elif np.abs(slack).max() > most:
                at = np.abs(slack).argmax()
                signs[at] = np.sign(slack[at])
            else:
                return found
        return None

    def proximal(gram, moment, precision, changes, weights, noise, noise_of):
        """Accelerated proximal gradient for the changes' absolute values, the noise again after each solution."""
        ridge = precision.copy()
        ridge[changes] = 0
        left = steps
        while left > 0:
            hessian, linear = gram / noise + np.diag(ridge), moment / noise
            scale = 1 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))
            step = 1 / np.linalg.eigvalsh(hessian * np.outer(scale, scale))[-1]
            threshold = np.zeros(len(weights))
            threshold[changes] = step * scale[changes] / CHANGE_SCALE
            ahead = point = weights / scale
            speed, found = 1.0, changes_solved(hessian, linear, weights, changes)
            while found is None and left > 0:
                for _ in range(100):
                    moved = ahead - step * scale * (hessian @ (scale * ahead) - linear)
                    moved = np.sign(moved) * np.maximum(np.abs(moved) - threshold, 0)
                    if (ahead - moved) @ (moved - point) > 0:
                        speed = 1.0  # it overshot: start anew from here
                    faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
                    ahead, point, speed = moved + (speed - 1) / faster * (moved - point), moved, faster
                left -= 100
                found = changes_solved(hessian, linear, scale * point, changes)
            if found is None:
                return scale * point, noise, False
            before, weights = weights, found
            noise, earlier = noise_of(weights), noise
            if abs(noise - earlier) <= 1e-10 * earlier and np.abs(weights - before).max() < 1e-9:
                return weights, noise, True
            left -= 1
        return weights, noise, False

    def fit(key: tuple, series: pd.DataFrame) -> pd.DataFrame:
        """Most probable trend and season of one category's weeks (columns ``day``, ``y``)."""
        series = series.sort_values("day")
        day, y = series["day"].to_numpy(), series["y"].to_numpy(dtype=float)
        n = len(y)
        columns = [field.split()[0] for field in MODEL_SCHEMA.split(", ")]
        if n < 2:
            return pd.DataFrame([(key[0], *[None] * 10, day, y)], columns=columns)
        span, scale = float(day[-1] - day[0]), np.abs(y).max() or 1.0

        usable = int(n * CHANGEPOINT_SHARE)
        n_knots = max(min(CHANGEPOINTS, usable - 1), 0)
        knots = day[np.linspace(0, max(usable - 1, 0), n_knots + 1).round().astype(int)][1:]
        angle = 2 * math.pi / YEAR_DAYS * np.outer(day, np.arange(1, FOURIER_ORDER + 1))
        hinges = np.maximum(day[:, None] - knots, 0) / span
        design = np.column_stack([np.ones(n), (day - day[0]) / span, hinges, np.sin(angle), np.cos(angle)])

        # Maximum a posteriori by reweighted least squares: a Laplace prior acts like a
        # normal one whose variance is the current |change| times its scale, and the
        # noise variance has a closed form between two solves.
        precision = np.r_[np.full(2, 1 / TREND_VARIANCE), np.ones(n_knots), np.full(2 * FOURIER_ORDER, 1 / SEASON_VARIANCE)]
        gram, moment = design.T @ design, design.T @ (y / scale)
        weights, noise = np.zeros(design.shape[1]), np.var(y / scale) or 1.0
        changes = slice(2, 2 + n_knots)

        def noise_of(weights):
            rss = np.square(y / scale - design @ weights).sum()
            return max((math.sqrt(n * n + 16 * rss) - n) / 8, 1e-8)

        converged = constant = y.min() == y.max()
        for _ in range(0 if constant else rounds):
            before = weights
            weights = np.linalg.solve(gram / noise + np.diag(precision), moment / noise)
            precision[changes] = 1 / (CHANGE_SCALE * np.maximum(np.abs(weights[changes]), 1e-7))
            noise = noise_of(weights)
            if np.abs(weights - before).max() < 1e-9:
                converged = True
                break
        solver = "reweighted"
        if constant:
            weights[0] = y[0] / scale
        elif not converged and steps:
            solver = "proximal"
            weights, noise, converged = proximal(gram, moment, precision, changes, weights, noise, noise_of)

        level, slope, bends, sines, cosines = np.split(weights * scale, np.cumsum([1, 1, n_knots, FOURIER_ORDER]))
        row = (key[0], day[0], day[-1], level[0], slope[0] / span, knots, bends / span, sines, cosines, solver, bool(converged), day, y)
        return pd.DataFrame([row], columns=columns)

    return fit


def category_models(weekly: DataFrame) -> DataFrame:
    """One fitted model per category.

    The number of partitions is given, so that AQE does not merge the tiny
    series into one task and fit them one after the other.
    """
    tasks = int(weekly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        weekly.select("item_category", F.unix_date("week_end").alias("day"), "y")
        .repartition(tasks, "item_category")
        .groupBy("item_category")
        .applyInPandas(series_fitter(), MODEL_SCHEMA)
    )


def _dates(first: Column, last: Column, periods: int, step_days: int) -> Column:
    """The weeks of the history and the steps after it."""

    def every(days: int) -> Column:
        return F.expr(f"INTERVAL {days} DAYS")

    future = F.sequence(F.date_add(last, step_days), F.date_add(last, periods * step_days), every(step_days))
    return F.concat(F.sequence(first, last, every(7)), future)


def forecast_calendar(weekly: DataFrame, periods: int = FORECAST_DAYS, step_days: int = 1) -> DataFrame:
    """Dates to predict for each category: its weeks, then ``periods`` steps."""
    # Over whole (week, sales) pairs, as the weeks' own range is: one scan serves both.
    pair = F.struct("week_end", "y")
    ends = weekly.groupBy("item_category").agg(
        F.min(pair)["week_end"].alias("first"), F.max(pair)["week_end"].alias("last")
    )
    dates = _dates(F.col("first"), F.col("last"), periods, step_days)
    return ends.select("item_category", F.explode(dates).alias("ds"))


def _predicted(ds: Column) -> Column:
    """Trend plus season on date ``ds``, from the columns of a fitted model."""
    day = F.unix_date(ds)
    bent = F.aggregate(
        F.zip_with("knots", "bends", lambda knot, bend: bend * F.greatest(day - knot, F.lit(0))),
        F.lit(0.0),
        lambda total, part: total + part,
    )
    year = F.lit(2 * math.pi / YEAR_DAYS) * day
    season = sum(
        (
            F.col("sines")[k - 1] * F.sin(year * k) + F.col("cosines")[k - 1] * F.cos(year * k)
            for k in range(1, FOURIER_ORDER + 1)
        ),
        F.lit(0.0),
    )
    return F.col("level") + F.col("slope") * (day - F.col("first_day")) + bent + season


def predict(models: DataFrame, periods: int = FORECAST_DAYS, step_days: int = 1) -> DataFrame:
    """Predicted sales for the weeks of the history and ``periods`` steps after it.

    ``converged`` tells of each row whether the fit behind it came to an end.
    """
    first, last = F.date_from_unix_date("first_day"), F.date_from_unix_date("last_day")
    dated = models.where("level IS NOT NULL").withColumn("ds", F.explode(_dates(first, last, periods, step_days)))
    return dated.select("ds", _predicted(F.col("ds")).alias("y"), "item_category", "converged")


def category_forecast(weekly: DataFrame, periods: int = FORECAST_DAYS, step_days: int = 1) -> DataFrame:
    """Fit and predict every category."""
    return predict(category_models(weekly), periods, step_days)


def actual_vs_forecast(weekly: DataFrame, periods: int = FORECAST_DAYS, step_days: int = 1) -> DataFrame:
    """Actual and forecast rows under one another, told apart by ``type``.

    ``converged`` tells of a forecast whether its fit came to an end, and is null for sales.
    """
    models = category_models(weekly)
    first, last = F.date_from_unix_date("first_day"), F.date_from_unix_date("last_day")
    # A model's row holds its weeks, so that one pass over the sales gives both kinds.
    actual = F.transform(
        F.arrays_zip("days", "sold"), lambda week: F.struct(F.date_from_unix_date(week["days"]).alias("ds"), week["sold"].alias("sold"))
    )
    ahead = F.transform(
        F.coalesce(_dates(first, last, periods, step_days), F.array().cast("array<date>")),
        lambda ds: F.struct(ds.alias("ds"), F.lit(None).cast("double").alias("sold")),
    )
    kinds = F.array(
        F.struct(F.lit("Actual").alias("type"), actual.alias("dated")), F.struct(F.lit("Forecast").alias("type"), ahead.alias("dated"))
    )
    rows = models.withColumn("kind", F.explode(kinds)).withColumn("at", F.explode("kind.dated"))
    value = F.when(F.col("kind.type") == "Actual", F.col("at.sold")).otherwise(_predicted(F.col("at.ds")))
    ended = F.when(F.col("kind.type") == "Forecast", F.col("converged"))
    return rows.select(F.col("at.ds").alias("ds"), value.alias("y"), "item_category", F.col("kind.type").alias("type"), ended.alias("converged"))


def forecast_fits(weekly: DataFrame) -> DataFrame:
    """How the fit of each category went: its weeks, solver, whether it converged, and where its trend bends."""
    bends = F.filter("bends", lambda bend: F.abs(bend) * (F.col("last_day") - F.col("first_day")) > 1e-6 * F.abs("level"))
    return category_models(weekly).select(
        "item_category", F.size("days").cast("long").alias("n_weeks"), "solver", "converged", F.size(bends).alias("n_bends")
    )


def category_trend(weekly: DataFrame) -> DataFrame:
    """Straight line through each category's weeks; week 0 ends on 4 January 1970."""
    week = (F.unix_date("week_end") - 3) / 7
    return weekly.groupBy("item_category").agg(
        F.count("y").alias("n_weeks"),
        F.regr_slope("y", week).alias("slope"),
        F.regr_intercept("y", week).alias("intercept"),
    )


def trend_of_runs(runs: DataFrame) -> DataFrame:
    """``category_trend`` from ``weekly_runs``: a run without sales counts in closed form, however long."""
    at = F.floor((F.unix_date("week_end") - 3) / 7).cast("decimal(12,0)")
    n = F.col("weeks").cast("decimal(12,0)")
    sums = runs.groupBy("item_category").agg(
        F.sum(n).alias("n"),
        F.sum(n * at + n * (n - 1) / 2).cast("decimal(30,0)").alias("x"),
        F.sum(n * at * at + at * n * (n - 1) + n * (n - 1) * (2 * n - 1) / 6).cast("decimal(38,0)").alias("xx"),
        # Weeks with sales are runs of one, so these need no length.
        F.sum("y").alias("y"),
        F.sum(F.col("y") * at.cast("double")).alias("xy"),
    )
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    spread = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")).cast("double")
    slope = F.try_divide(n * F.col("xy") - x * F.col("y"), spread)
    return sums.select(
        "item_category", F.col("n").cast("long").alias("n_weeks"), slope.alias("slope"), ((F.col("y") - slope * x) / n).alias("intercept")
    )
