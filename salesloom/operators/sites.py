"""Sales by location, candidate selling sites and their predicted sales."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.encoding import hash_bucket, with_ordinals
from salesloom.functions.fixed_values import (
    ALL,
    CITY_CENTERS,
    DEFAULT_CENTER,
    MODEL_SEED,
    MODEL_TREES,
    RING_DEGREES,
    SITES_PER_RING,
    TRAIN_PERCENT,
)
from salesloom.operators.filters import Choice
from salesloom.operators.options import distinct_values
from salesloom.session import stored

# Split points tried for a feature.
MODEL_BINS = 64
MODEL_SETTINGS = {"maxDepth": 3, "stepSize": 0.1}

LOCATION_KEYS = ("latitude", "longitude", "menu_type", "item_category", "season", "time_of_day")

# Steps of a two-dimensional low-discrepancy sequence: the powers 1 and 2 of
# 1/g, where g is the real root of g^3 = g + 1. Points spread evenly, and the same
# ones come out on every run.
STEP_LAT, STEP_LON = 0.7548776662466927, 0.5698402909980532


def location_sales(sales: DataFrame) -> DataFrame:
    """Total sales by place, menu, category, season and time of day."""
    return sales.groupBy(*LOCATION_KEYS).agg(F.sum("price").alias("total_sales"))


def north_to_south(locations: DataFrame) -> DataFrame:
    """From north to south, east to west, then by menu."""
    return locations.orderBy(F.desc("latitude"), F.desc("longitude"), F.asc("menu_type"))


def sales_bounds(locations: DataFrame) -> DataFrame:
    """Lowest and highest total sales of a location."""
    return locations.agg(F.min("total_sales").alias("min_sales"), F.max("total_sales").alias("max_sales"))


def location_domains(sales: DataFrame) -> DataFrame:
    """Distinct seasons, times of day and categories, of locations or of sales.

    Both have the same values; taken from the sales, no locations are totalled first.
    """
    return distinct_values(sales, ("season", "time_of_day", "item_category"))


def city_centers(cities: DataFrame, centers: DataFrame) -> DataFrame:
    """Centre of each city, with a default for cities that have none."""
    return cities.join(centers, "city", "left").select(
        "city",
        F.coalesce("lat", F.lit(DEFAULT_CENTER[0])).alias("lat"),
        F.coalesce("lon", F.lit(DEFAULT_CENTER[1])).alias("lon"),
    )


def center_of(
    city: str, centers: Iterable[tuple[str, float, float]] = CITY_CENTERS
) -> tuple[float, float]:
    """Centre of one city, or the default."""
    return {name: (lat, lon) for name, lat, lon in centers}.get(city, DEFAULT_CENTER)


def candidate_sites(
    locations: DataFrame,
    menu_type: str,
    center: tuple[float, float] = DEFAULT_CENTER,
    categories: Choice = None,
) -> DataFrame:
    """Candidate sites in three boxes around a centre, for every category.

    Categories are the chosen ones, sold there or not; without a choice those that are
    sold, null among them. Each unfolds into the fixed number of sites. Seasons and times
    of day go round through the values that occur, at most four each, so that their
    pairs come up evenly. Without any location there are no sites.
    """

    def seen(column: str) -> Column:
        return F.sort_array(F.collect_set(column))

    def pick(values: str, turn: Column) -> Column:
        return F.try_element_at(F.col(values), (F.try_mod(turn, F.size(values)) + 1).cast("int"))

    def spread(step: float) -> Column:
        position = F.col("site_id") * F.lit(step)
        return (2 * (position - F.floor(position)) - 1) * F.col("reach")

    unnamed = F.when(F.max(F.col("item_category").isNull()), F.array(F.lit(None).cast("string")))
    sold = F.concat(seen("item_category"), F.coalesce(unnamed, F.array().cast("array<string>")))
    chosen = [categories] if isinstance(categories, str) else categories
    if chosen is not None and ALL not in chosen:
        sold = F.array(*map(F.lit, dict.fromkeys(chosen))).cast("array<string>")
    last_id = SITES_PER_RING * len(RING_DEGREES) - 1
    return (
        locations.agg(
            seen("season").alias("seasons"), seen("time_of_day").alias("dayparts"), sold.alias("categories"),
            F.count(F.lit(1)).alias("n_locations"),
        )
        .where("n_locations > 0")
        .withColumn("item_category", F.explode("categories"))
        .withColumn("site_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last_id).cast("long"))))
        .withColumn("ring", F.floor(F.col("site_id") / SITES_PER_RING).cast("int"))
        .withColumn("reach", F.element_at(F.array(*map(F.lit, RING_DEGREES)), F.col("ring") + 1))
        .select(
            "site_id",
            "ring",
            (F.lit(center[0]) + spread(STEP_LAT)).alias("latitude"),
            (F.lit(center[1]) + spread(STEP_LON)).alias("longitude"),
            F.lit(menu_type).alias("menu_type"),
            "item_category",
            pick("seasons", F.col("site_id")).alias("season"),
            pick("dayparts", F.floor(F.col("site_id") / F.greatest(F.size("seasons"), F.lit(1)))).alias("time_of_day"),
        )
    )


def with_split(locations: DataFrame) -> DataFrame:
    """Marks each location row for training or for the hold-out, by its keys alone."""
    keys = [F.col(name).try_cast("decimal(9,6)").cast("string") for name in ("latitude", "longitude")]
    keys += [F.col(name) for name in LOCATION_KEYS[2:]]
    train = hash_bucket(*(F.coalesce(key, F.lit("")) for key in keys)) < TRAIN_PERCENT
    return locations.withColumn("split", F.when(train, "train").otherwise("test"))


def _trainable(locations: DataFrame) -> DataFrame:
    """Encoded rows, each marked for training or for the hold-out.

    Without a place, a season or sales there is nothing to learn; a row without a
    category stays, in a slot of its own.
    """
    return with_ordinals(with_split(locations)).dropna(
        subset=["latitude", "longitude", "season_encoded", "total_sales"]
    )


def training_rows(locations: DataFrame) -> DataFrame:
    """What a model learns from: the features and total sales of the training part."""
    return _trainable(locations).filter("split = 'train'").drop("split", "season", "time_of_day", "menu_type")


def fit_site_model(
    locations: DataFrame,
    trees: int = MODEL_TREES,
    seed: int = MODEL_SEED,
    bins: int = MODEL_BINS,
    tasks: int | None = None,
) -> PipelineModel | None:
    """Boosted trees that predict a location's total sales; None without a row to train on.

    Training passes over its rows once per tree level. They are written to the
    shared folder first, so that a lost executor costs a read from there and not a scan
    of the facts, and so that hundreds of jobs do not each carry the plan behind the
    rows; the table goes when the model is there. ``bins`` bounds the split points tried
    for a feature, ``tasks`` the tasks of a pass (else as the stored rows are split).
    """
    with stored(training_rows(locations)) as training:
        if training.isEmpty():
            return None
        return fit_on(training.coalesce(tasks) if tasks else training, trees, seed, bins)


def fit_on(training: DataFrame, trees: int = MODEL_TREES, seed: int = MODEL_SEED, bins: int = MODEL_BINS) -> PipelineModel:
    """The model of some ``training_rows``.

    One fitted pipeline encodes training rows and candidate sites alike; a
    category it never saw gets its own slot.
    """
    indexer = StringIndexer(
        inputCol="item_category",
        outputCol="category_index",
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    )
    flags = OneHotEncoder(inputCol="category_index", outputCol="category_flags", handleInvalid="keep")
    features = VectorAssembler(
        inputCols=["latitude", "longitude", "season_encoded", "time_encoded", "category_flags"],
        outputCol="features",
    )
    booster = GBTRegressor(
        labelCol="total_sales",
        predictionCol="predicted_sales",
        maxIter=trees,
        maxBins=bins,
        seed=seed,
        **MODEL_SETTINGS,
    )
    return Pipeline(stages=[indexer, flags, features, booster]).fit(training)


def score_sites(model: PipelineModel | None, sites: DataFrame) -> DataFrame:
    """Candidate sites with their predicted sales: null where there is no season or no model."""
    if model is None:
        return sites.withColumn("predicted_sales", F.lit(None).cast("double"))
    ready = with_ordinals(sites).fillna(0, ["season_encoded", "time_encoded"])
    scored = model.transform(ready).withColumn("predicted_sales", F.when(F.col("season").isNotNull(), F.col("predicted_sales")))
    return scored.select(*sites.columns, "predicted_sales")


def heat_points(scores: DataFrame) -> DataFrame:
    """Latitude, longitude and weight of each point of a heat map."""
    return scores.select("latitude", "longitude", "predicted_sales")


def _rmse(guess: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.col("total_sales") - guess, 2)))


def _training_mean(rows: DataFrame) -> Column:
    return rows.filter("split = 'train'").select(F.avg("total_sales")).scalar()


def split_stats(locations: DataFrame) -> DataFrame:
    """Rows of both parts of the split, and the error of the plain training mean on them."""
    rows = _trainable(locations)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), _rmse(_training_mean(rows)).alias("rmse_of_mean")
    )


def model_metrics(model: PipelineModel | None, locations: DataFrame) -> DataFrame:
    """``split_stats`` with the error of the model; null without one."""
    rows = _trainable(locations)
    if model is None:
        return split_stats(locations).withColumn("rmse", F.lit(None).cast("double"))
    return (
        model.transform(rows)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            _rmse(F.col("predicted_sales")).alias("rmse"),
            _rmse(_training_mean(rows)).alias("rmse_of_mean"),
        )
    )
