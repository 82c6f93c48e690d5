"""Site models kept by what they were trained on.

A model lies in the shared folder under a fingerprint of its training rows, its settings
and Spark's version. Whoever asks with the same rows and settings gets it without a fit,
in any session that names the same folder; a table that changes, under whatever path,
asks for another model. Without a shared folder a model is remembered by the application.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from salesloom.functions.fixed_values import MODEL_SEED, MODEL_TREES
from salesloom.functions.names import quoted
from salesloom.operators import sites
from salesloom.session import remove, shared_folder, stored

#: Sums come out with another last digit when they are added up in another order.
DIGITS = 4

#: Models that an application remembers.
REMEMBERED = 16
_remembered: dict[tuple[str, str], PipelineModel] = {}


def _stable(rows: DataFrame) -> list[Column]:
    """The columns by name, sums without the digits that depend on their order, nulls told apart."""
    columns = []
    for name in sorted(rows.columns):
        value = F.col(quoted(name))
        if isinstance(rows.schema[name].dataType, DoubleType | FloatType):
            value = F.round(value, DIGITS) + F.lit(0.0)
        columns += [value, F.col(quoted(name)).isNull()]
    return columns


def fingerprint(rows: DataFrame, **settings: object) -> str:
    """Text that stands for the rows, in any order and partitioning, and for the settings.

    One job without a shuffle of rows: two 64-bit hashes of each row, added up and xored.
    """
    columns = _stable(rows)
    first, second = F.xxhash64(F.lit("sum"), *columns), F.xxhash64(F.lit("xor"), *columns)
    parts = rows.agg(F.count(F.lit(1)), F.sum(first.cast("decimal(20,0)")), F.bit_xor(second)).first()
    told = [sorted(rows.dtypes), [str(part) for part in parts], sorted(settings.items()), rows.sparkSession.version]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()[:32]


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _save(spark: SparkSession, model: PipelineModel, place: str) -> None:
    """Written aside and renamed, so that nobody reads half a model."""
    aside = f"{place}.{uuid.uuid4().hex}"
    model.save(aside)
    files, target = _path(spark, place)
    if files.exists(target) or not files.rename(_path(spark, aside)[1], target):
        remove(spark, aside)


def site_model(
    locations: DataFrame,
    trees: int = MODEL_TREES,
    seed: int = MODEL_SEED,
    bins: int = sites.MODEL_BINS,
    folder: str | None = None,
) -> PipelineModel | None:
    """The model of these locations: a stored one, or else a new one, which is stored.

    ``folder`` holds the models; without it the shared folder does. None without a row to
    train on.
    """
    spark = locations.sparkSession
    folder = folder or shared_folder(spark)
    with stored(sites.training_rows(locations)) as training:
        if training.isEmpty():
            return None
        key = fingerprint(training, trees=trees, seed=seed, bins=bins, **sites.MODEL_SETTINGS)
        known = spark.sparkContext.applicationId, key
        if known in _remembered:
            return _remembered[known]
        place = f"{folder.rstrip('/')}/site-models/{key}" if folder else None
        if place and _path(spark, place)[0].exists(_path(spark, place)[1]):
            model = PipelineModel.load(place)
        else:
            model = sites.fit_on(training, trees, seed, bins)
            if place:
                _save(spark, model, place)
    while len(_remembered) >= REMEMBERED:
        del _remembered[next(iter(_remembered))]
    _remembered[known] = model
    return model
