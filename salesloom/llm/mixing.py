"""Mixing sources to target weights: cube-method balanced sampling.

A source's target over its size is how often its documents are to be taken on average.
The whole part of that ratio is taken for sure. For the fraction the cube method draws a
sample that keeps, within each source, both the number of documents and their total
size. Its flight moves three documents at a time: their inclusion probabilities run
along the one direction that changes neither total, until one of them is 0 or 1. Two
documents are left where it ends, so documents fly in blocks of bounded size, what
blocks leave is gathered into new blocks, and so on until a source fits into one. There
the shortest few documents and what the flight leaves land: all their outcomes are
tried, and the one with the smallest error in size is taken.

The draw depends on hashes of the documents' ids and of the seed alone, so reruns agree.
Each turn orders a block by one hash and decides by another, so that which way chances
move has nothing to do with where a document stands; only the few that land are decided
by the error and not by chance.

A null source is a source, the last one; null texts have size 0. Rows that share a
doc_id are drawn each for itself. A source without words has target 0 and nothing taken.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import WORD, Scratch, free_name, numbered
from salesloom.llm.common import mix as scramble

#: Documents of one flight.
BLOCK_ROWS = 4096
WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
#: Documents of a source that do not fly but land, with the two that the flight leaves.
LANDING = 10
ENDED = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """The documents with `size`, their number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))


def ranked(values: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """Rows with `rank` from 0 by a column of distinct values, nulls last.

    Sorted in ranges; only the ranges' row counts meet in one window.
    """
    order = F.col(by).asc_nulls_last()
    placed = scratch.table(values.repartitionByRange(order).withColumn("block", F.spark_partition_id()), "ranges")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("block").count().select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    in_block = F.row_number().over(Window.partitionBy("block").orderBy(order)) - 1
    return placed.withColumn("at", in_block).join(offsets, "block").withColumn("rank", F.col("offset") + F.col("at")).drop("block", "at", "offset")


def targets(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) of sources that weigh `weights` in turn.

    The targets add up to all sizes. One that would pass `most` times its source's size
    stops there, and the rest is shared anew by weight until none does.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.pmod("rank", F.lit(len(weights))).cast("int") + 1
    shares = ranked(totals, "source", scratch).withColumn("weight", F.element_at(F.lit(list(weights)), turn))
    shares = scratch.table(shares.withColumn("most", (F.col("source_size") * most).cast("double")), "shares")

    level = None
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("most")
        at_most, free = shares.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not free:
            break
        shared = (total - at_most) / free
        if shared == level:
            break
        level = shared
    wanted = F.least(F.col("weight") * F.lit(level or 0.0), F.col("most"))
    return shares.select("source", "source_size", "n_docs", wanted.alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves chances until two at most lie between 0 and 1; their sum and that of size * chance stay."""
    chance = chance.copy()
    open_rows: list[int] = []
    for k in range(len(size)):
        if chance[k] <= ENDED or chance[k] >= 1 - ENDED:
            continue
        open_rows.append(k)
        if len(open_rows) < 3:
            continue
        a, b, c = open_rows
        step = np.array([size[c] - size[b], size[a] - size[c], size[b] - size[a]])
        if not step.any():
            step = np.array([1.0, -1.0, 0.0])
        step = step / np.abs(step).max()
        now = chance[open_rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(step > 0, (1 - now) / step, np.where(step < 0, -now / step, np.inf)))
            down = np.min(np.where(step > 0, now / step, np.where(step < 0, (now - 1) / step, np.inf)))
        # Up with chance down / (up + down): no probability changes on average.
        now = now + step * (up if draws[k] * (up + down) < down else -down)
        chance[open_rows] = now
        open_rows = [r for r in open_rows if ENDED < chance[r] < 1 - ENDED]
    return np.where(chance <= ENDED, 0.0, np.where(chance >= 1 - ENDED, 1.0, chance))


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Ends the last few chances: of all outcomes the one whose size is nearest, then whose count is."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    if not len(left):
        return chance
    outcomes = np.array(list(itertools.product((0.0, 1.0), repeat=len(left)))).reshape(-1, len(left))
    error = np.abs((outcomes - chance[left]) @ size[left]) + 1e-6 * np.abs((outcomes - chance[left]).sum(axis=1))
    chance = chance.copy()
    chance[left] = outcomes[np.argmin(error)]
    return chance


def _hashed(draw: np.ndarray, turn: int, use: int) -> np.ndarray:
    """A hash of a row's draw of its own for each turn and use."""
    return scramble(draw.view(np.uint64) ^ scramble(np.array([2 * turn + use + 1], dtype=np.uint64)))


def _flight(last: bool, turn: int = 0):
    def flown(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(place=_hashed(rows["draw"].to_numpy(dtype=np.int64), turn, 0))
        # The final flight takes long documents first, so that short ones are left to land.
        by = ["size", "place", "row_id"] if last else ["place", "size", "row_id"]
        rows = rows.sort_values(by, ascending=not last).reset_index(drop=True)
        size = rows["size"].to_numpy(dtype=float)
        draws = (_hashed(rows["draw"].to_numpy(dtype=np.int64), turn, 1) >> np.uint64(11)) / 2.0**53
        chance = rows["chance"].to_numpy(dtype=float, copy=True)
        flying = len(rows) - LANDING if last else len(rows)
        if flying > 0:
            chance[:flying] = fly(size[:flying], chance[:flying], draws)
        rows["chance"] = land(size, chance) if last else chance
        return rows[["row_id", "source", "size", "draw", "chance"]]

    return flown


CHANCES = "row_id long, source string, size long, draw long, chance double"


def draw(chances: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, chance) with every chance ended at 0 or 1, from rows with the columns of CHANCES."""
    ended = []
    for turn in itertools.count():
        blocks = scratch.table(
            chances.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / block_rows).alias("blocks")),
            f"blocks-{turn}",
        )
        last = (blocks.agg(F.max("blocks")).first()[0] or 1) == 1
        dealt = chances.join(blocks, F.col("source").eqNullSafe(F.col("of"))).withColumn(
            "block", F.pmod(F.xxhash64("draw", F.lit(turn)), F.col("blocks"))
        )
        flown = dealt.select("row_id", "source", "size", "draw", "chance", "block").groupBy("source", "block")
        flown = scratch.table(flown.applyInPandas(_flight(last, turn), CHANCES), f"flight-{turn}")
        between = (F.col("chance") > 0) & (F.col("chance") < 1)
        ended.append(flown.where(~between).select("row_id", "chance"))
        if last:
            return functools.reduce(DataFrame.unionByName, ended)
        chances = flown.where(between)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17) -> DataFrame:
    """A row a document: row_id, doc_id, source, size, source_size, target, copies, taken.

    row_id is the document's place in the table, which is read twice by `take_copies`: it
    must give the same rows in the same order each time, as a stored table does.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.when(F.col("doc_id").isNull(), F.col("row_id")).otherwise(F.col("doc_id"))
    sized = sizes(numbered(docs.select("doc_id", "text", "source"), "row_id"))
    sized = scratch.table(sized.drop("text").withColumn("draw", F.xxhash64(key, F.lit(seed))), "sizes")

    goals = scratch.table(targets(sized, scratch, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("ratio", ratio).withColumnRenamed("source", "of")
    wanted = sized.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of", "n_docs")
    wanted = wanted.withColumn("whole", F.floor("ratio"))
    chances = wanted.select("row_id", "source", "size", "draw", (F.col("ratio") - F.col("whole")).alias("chance"))
    drawn = draw(chances, scratch)
    return (
        wanted.join(drawn, "row_id")
        .withColumn("copies", (F.col("whole") + F.col("chance")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row_id", "doc_id", "source", "size", "source_size", "target", "copies", "taken")
    )


def take_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns."""
    row, times = free_name(docs, "row"), free_name(docs, "copies")
    copies = mix(docs, weights, most).where("copies > 0").select(F.col("row_id").alias(row), F.col("copies").alias(times))
    taken = numbered(docs, row).join(copies, row)
    taken = taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))
