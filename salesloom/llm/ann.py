"""Approximate nearest neighbours: multiprobe p-stable hashing.

Vectors are put on a sphere, with one more component, so that the largest inner product
is the smallest distance. Each table hashes them by some Gaussian projections cut
into steps. A query visits its own bucket and then those beside it, in the order in which
they are likely to hold a neighbour: by the squared distances from the query to the
edges that it would have to cross. What the buckets of all tables hold is ranked by the
exact inner product of the original vectors.

How many tables, functions and probes there are and how wide a step is follows the
vectors and their number. `DRAWN_QUERIES` queries are compared with all entries, so their
neighbours are known; of the families tried, that one is taken which scores the fewest
entries, judged by `DRAWN_ENTRIES` of them, and yet finds `RECALL` of these neighbours, or
the most of them if none finds as many. A query visits `VISITS` buckets however many
tables share them. The nearer neighbours lie against the rest, the
less is scored. Every vector is indexed whatever was drawn.

Equal vectors are one entry of the index, with their smallest ids beside it. Entries and
probes of one bucket are dealt into blocks of bounded size and each block of one meets
each of the other, so a hot bucket is spread. Queries that find too few candidates are
compared with all entries, block by block.

Vectors that are null, empty, zero, or hold null or non-finite components take no part;
vectors of different lengths are no candidates for each other. Repeated rows are one; of
an id with several vectors each is a candidate and, if asked for, a query, and none finds
its own id. Rows without an id take no part, other columns neither.
"""

from __future__ import annotations

import functools
import heapq
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, mix


class Family(NamedTuple):
    """How vectors are hashed, and how it did on what was drawn: recall and share of entries scored."""

    tables: int
    functions: int
    step: float
    probes: int
    recall: float | None = None
    share: float | None = None


#: Where nothing could be drawn.
DEFAULT = Family(4, 4, 1.2, 70)
#: What is tried: functions, steps against the neighbours' median distance, tables.
FUNCTIONS, STEPS, TABLES = (4, 6, 8), (0.85, 1.0, 1.15, 1.3, 1.5), (1, 2, 4, 8)
#: Buckets that a query visits in all its tables, so that the work beside scoring follows the rows.
VISITS = 320
#: Queries and entries that are drawn to choose, and the share of their neighbours to be found.
DRAWN_QUERIES, DRAWN_ENTRIES, RECALL = 64, 2048, 0.93
#: Entries or probes of one block.
BLOCK_ROWS = 50_000
SEED = 29


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & whole & some)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x))


def projections(dim: int, tables: int, functions: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dim + 1, tables * functions) and offsets, the same wherever they are drawn."""
    drawn = [np.random.default_rng([SEED, dim, table]) for table in range(tables)]
    directions = [rng.normal(size=(dim + 1, functions)) for rng in drawn]
    return np.concatenate(directions, axis=1), np.concatenate([rng.uniform(0, step, functions) for rng in drawn])


def on_sphere(v: np.ndarray, largest: float | None) -> np.ndarray:
    """Entries, shorter than `largest`, or queries (None) as points of a sphere with a dimension more."""
    if largest is None:
        return np.c_[v / np.linalg.norm(v, axis=1)[:, None], np.zeros(len(v))]
    v = v / largest
    return np.c_[v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(axis=1)))]


def probe_order(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """Steps away from the own bucket, likeliest first.

    `inside` is how far into its bucket the query lies in each function, 0 to 1. A
    function may stay, go one down or go one up; what it costs is the squared distance to
    the edge crossed.
    """
    moves = sorted([(x * x, f, -1) for f, x in enumerate(inside)] + [((1 - x) ** 2, f, 1) for f, x in enumerate(inside)])
    order = [np.zeros(len(inside), dtype=np.int64)]
    waiting = [(moves[0][0], (0,))]
    while waiting and len(order) < probes:
        cost, chosen = heapq.heappop(waiting)
        functions = [moves[m][1] for m in chosen]
        if len(set(functions)) == len(functions):
            steps = np.zeros(len(inside), dtype=np.int64)
            for m in chosen:
                steps[moves[m][1]] = moves[m][2]
            order.append(steps)
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(waiting, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(waiting, (cost + moves[last + 1][0], (*chosen, last + 1)))
    return order


def costs_of(inside: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What it costs each query (rows of `inside`) to go the steps, beside none more than one: see `probe_order`."""
    cost = np.where(steps == -1, inside * inside, np.where(steps == 1, (1 - inside) ** 2, 0.0))
    return np.where(np.abs(steps) > 1, np.inf, cost).sum(axis=-1)


@functools.lru_cache
def _moves(functions: int) -> np.ndarray:
    return np.array(list(product((-1, 0, 1), repeat=functions)))


def probe_orders(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """`probe_order` for each row of `inside`; of few functions, by sorting all there are."""
    if inside.shape[1] > max(FUNCTIONS):
        return [np.array(probe_order(row, probes)) for row in inside]
    moves = _moves(inside.shape[1])
    orders = []
    for at in range(0, len(inside), 256):
        costs = costs_of(inside[at : at + 256, None, :], moves[None])
        orders += [moves[np.argsort(cost, kind="stable")[:probes]] for cost in costs]
    return orders


def _bucket_names(dim: int, table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A 64-bit name for each bucket: its table, the vectors' length and its cell."""
    name = mix(np.full(len(cells), dim, dtype=np.uint64) * np.uint64(4096) + table.astype(np.uint64))
    for k in range(cells.shape[1]):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + cells[:, k].astype(np.int64).view(np.uint64))
    return name.view(np.int64)


def _by_length(ids: list[int], vectors: list[list[float]]):
    lengths = np.array([len(v) for v in vectors])
    for dim in np.unique(lengths):
        of = np.flatnonzero(lengths == dim)
        yield int(dim), np.array(ids)[of], np.array([vectors[k] for k in of], dtype=np.float64)


def _hashed(largest: float, probes: int, tables: int, functions: int, step: float):
    """Buckets of entries (probes = 0) or of queries."""
    schema = pa.schema([("id", pa.int64()), ("bucket", pa.int64())])

    def hashed(batches):
        for batch in batches:
            for dim, ids, v in _by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                directions, offsets = projections(dim, tables, functions, step)
                places = (on_sphere(v, None if probes else largest) @ directions + offsets) / step
                cells = np.floor(places).astype(np.int64)
                for table in range(tables):
                    own = slice(table * functions, (table + 1) * functions)
                    if not probes:
                        named = _bucket_names(dim, np.full(len(ids), table), cells[:, own])
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(named)], schema=schema)
                        continue
                    orders = probe_orders(places[:, own] - cells[:, own], probes)
                    visited = [cell + steps for cell, steps in zip(cells[:, own], orders)]
                    of = np.repeat(ids, [len(x) for x in visited])
                    named = _bucket_names(dim, np.full(len(of), table), np.concatenate(visited))
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(named)], schema=schema)

    return hashed


class Drawn(NamedTuple):
    """Vectors of one length: queries, the queries' neighbours and then other entries.

    `near` has a row for each neighbour, in order: the places of its query and of itself.
    """

    queries: np.ndarray
    entries: np.ndarray
    near: np.ndarray


def _met(drawn: Drawn, functions: int, step: float, largest: float) -> dict[int, np.ndarray]:
    """By the number of tables, which entries each query meets."""
    dim = drawn.queries.shape[1]
    directions, offsets = projections(dim, max(TABLES), functions, step)
    asked = (on_sphere(drawn.queries, None) @ directions + offsets) / step
    held = np.floor((on_sphere(drawn.entries, largest) @ directions + offsets) / step)
    moves = _moves(functions)
    met = {tables: np.zeros((len(asked), len(held)), dtype=bool) for tables in TABLES}
    for table in range(max(TABLES)):
        own = slice(table * functions, (table + 1) * functions)
        cells = np.floor(asked[:, own])
        inside = (asked[:, own] - cells)[:, None, :]
        cost = costs_of(inside, held[None, :, own] - cells[:, None, :])
        dearest = np.sort(costs_of(inside, moves[None]), axis=1)
        for tables in TABLES:
            if table < tables:
                met[tables] |= cost <= dearest[:, min(VISITS // tables, len(moves)) - 1, None]
    return met


def choose(drawn: list[Drawn], largest: float, recall: float = RECALL) -> Family:
    """The family that scores the least of those that find enough, told by what was drawn."""
    gaps = [np.linalg.norm(on_sphere(d.queries[d.near[:, 0]], None) - on_sphere(d.entries[d.near[:, 1]], largest), axis=1) for d in drawn]
    gaps = np.concatenate(gaps) if gaps else np.empty(0)
    distance = float(np.median(gaps)) if len(gaps) else 0.0
    if not distance:
        return DEFAULT
    tried = []
    for functions, wide in product(FUNCTIONS, STEPS):
        step = float(f"{wide * distance:.2g}")
        counts = {tables: np.zeros(4) for tables in TABLES}
        for d in drawn:
            for tables, met in _met(d, functions, step, largest).items():
                others = met[:, len(d.near) :]
                counts[tables] += met[d.near[:, 0], d.near[:, 1]].sum(), len(d.near), others.sum(), others.size
        for tables, (found, near, scored, pairs) in counts.items():
            family = Family(tables, functions, step, VISITS // tables, float(found / near), float(scored / max(1, pairs)))
            tried.append((min(0.0, family.recall - recall), -family.share, -tables, family))
    return max(tried)[-1]


def _nearest(queries: list[tuple[int, list[float]]], most: int):
    """The best entries of a batch for each of a few queries."""
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    asked = {dim: (ids, v) for dim, ids, v in _by_length([q for q, _ in queries], [v for _, v in queries])}

    def nearest(batches):
        for batch in batches:
            for dim, ids, v in _by_length(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if dim not in asked:
                    continue
                names, vectors = asked[dim]
                scores = vectors @ v.T
                at = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                columns = np.repeat(names, at.shape[1]), ids[at.ravel()], np.take_along_axis(scores, at, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return nearest


def family_for(queries: DataFrame, index: DataFrame, nearest: int, largest: float, recall: float = RECALL) -> Family:
    """The family for these queries and entries, both (id, v)."""

    def some(rows: DataFrame, n: int) -> list[tuple[int, list[float]]]:
        return [(r.id, r.v) for r in rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(n).collect()]

    asking = some(queries, DRAWN_QUERIES)
    if not asking:
        return DEFAULT
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best_of = index.select("id", "v").mapInArrow(_nearest(asking, nearest + 1), "query long, id long, score double")
    best_of = best_of.where("query != id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= nearest)
    near = best_of.join(index, "id").select("query", "id", "v").collect()
    others = some(index, DRAWN_ENTRIES)
    drawn = []
    for dim, ids, vectors in _by_length([q for q, _ in asking], [v for _, v in asking]):
        place = {q: k for k, q in enumerate(ids.tolist())}
        pairs = sorted((place[r.query], r.id, r.v) for r in near if r.query in place)
        entries = [v for _, _, v in pairs] + [v for _, v in others if len(v) == dim]
        if pairs:
            found = np.array([(q, k) for k, (q, _, _) in enumerate(pairs)])
            drawn.append(Drawn(vectors, np.array(entries, dtype=np.float64), found))
    return choose(drawn, largest, recall)


def best(query: np.ndarray, entry: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Positions of each query's `most` best entries, every entry once, ties to the smaller id."""
    order = np.lexsort((entry, -score, query))
    query, entry = query[order], entry[order]
    first = np.unique(np.c_[query, entry], axis=0, return_index=True)[1]
    order = order[np.sort(first)]
    starts = np.flatnonzero(np.r_[True, np.diff(np.sort(query[np.sort(first)])) != 0]) if len(order) else np.empty(0, int)
    ranks = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[ranks < most]


FOUND = "query long, entry long, score double"


def _scored(most: int):
    """Ranks what a shard's probes meet: cells of equal number hold a block of entries and one of probes."""

    def scored(probes: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        columns: list[list[np.ndarray]] = [[], [], []]
        by_cell = entries.groupby("cell").indices
        entry_ids, entry_vectors = entries["id"].to_numpy(), entries["v"].to_numpy()
        probe_ids, probe_vectors = probes["id"].to_numpy(), probes["v"].to_numpy()
        visitors: dict[int, list[int]] = {}
        for k, cells in enumerate(probes["cells"]):
            for cell in cells:
                visitors.setdefault(cell, []).append(k)
        for cell, asking in visitors.items():
            if cell not in by_cell:
                continue
            held = by_cell[cell]
            scores = np.stack(probe_vectors[asking]) @ np.stack(entry_vectors[held]).T
            ids = entry_ids[held]
            if len(ids) > most:
                # The most-th best score of each query, and all entries that tie with it.
                least = np.partition(scores, -most, axis=1)[:, -most][:, None]
                q, e = np.nonzero(scores >= least)
            else:
                q, e = np.nonzero(np.ones_like(scores, dtype=bool))
            for column, values in zip(columns, (probe_ids[asking][q], ids[e], scores[q, e])):
                column.append(values)
        if not columns[0]:
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        query, entry, score = map(np.concatenate, columns)
        kept = best(query, entry, score, most)
        return pd.DataFrame({"query": query[kept], "entry": entry[kept], "score": score[kept]})

    return scored


def _compared(probes: DataFrame, entries: DataFrame, queries: DataFrame, index: DataFrame, most: int, shard_rows: int, scratch: Scratch, name: str) -> DataFrame:
    """Top entries of each query among those whose bucket it visits."""
    held = entries.groupBy("bucket").agg(F.count("*").alias("held"))
    asked = probes.groupBy("bucket").agg(F.count("*").alias("asked"))
    split = held.join(asked, "bucket").select(
        "bucket", F.ceil(F.col("held") / shard_rows).alias("e_blocks"), F.ceil(F.col("asked") / shard_rows).alias("p_blocks")
    )
    split = scratch.table(split, f"{name}-split")
    # Replicas of entries included, the shards hold some BLOCK_ROWS rows each.
    work = entries.join(split, "bucket").agg(F.sum("p_blocks")).first()[0] or 0
    shards = max(1, -(-work // shard_rows))

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(split, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        blocks = ("own", "other") if own == "e_blocks" else ("other", "own")
        return rows.withColumn("cell", F.xxhash64("bucket", *blocks)).withColumn("shard", F.pmod("cell", F.lit(shards)))

    entry_rows = placed(entries, "e_blocks", "p_blocks").select("id", "cell", "shard").join(index, "id")
    asking = placed(probes, "p_blocks", "e_blocks").groupBy("id", "shard").agg(F.collect_set("cell").alias("cells"))
    asking = asking.join(queries, "id")
    found = asking.groupBy("shard").cogroup(entry_rows.groupBy("shard")).applyInPandas(_scored(most), FOUND)
    return scratch.table(found, f"{name}-found")


def search(
    vectors: DataFrame, every: int, nearest: int, tables: int | None = None, functions: int | None = None,
    step: float | None = None, probes: int | None = None, block_rows: int = BLOCK_ROWS, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every` its nearest others.

    Tables, functions, step and probes are chosen by the vectors; once one of them is
    told, what is not told comes from `DEFAULT`.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    most = nearest + 1
    rows = usable(vectors).withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.reverse("v"), F.lit(1)))
    rows = scratch.table(rows.dropDuplicates(["vec_id", "a", "b"]), "rows")
    # Equal vectors: the smallest id stands for all, and no list ever needs more than `most` of them.
    order = Window.partitionBy("a", "b").orderBy("vec_id")
    copies = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    named = rows.groupBy("a", "b").agg(F.min("vec_id").alias("id"))
    copies = scratch.table(copies.join(named, ["a", "b"]), "copies")
    index = copies.where("at = 1").select("id", "v")
    members = copies.select(F.col("id").alias("entry"), "vec_id")
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "a", "b").join(named, ["a", "b"])
    asking = scratch.table(asking.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")), "asking")
    queries = scratch.table(index.join(asking.select(F.col("query").alias("id")).distinct(), "id", "left_semi"), "queries")

    largest, n_entries = index.agg(F.max(norm(F.col("v"))), F.count("*")).first()
    largest, told = largest or 1.0, (tables, functions, step, probes)
    if told == (None, None, None, None):
        family = family_for(queries, index, nearest, largest, recall)
    else:
        family = Family(*(given if given is not None else usual for given, usual in zip(told, DEFAULT)))
    hashing = family.tables, family.functions, family.step
    schema = "id long, bucket long"
    entries = scratch.table(index.mapInArrow(_hashed(largest, 0, *hashing), schema), "entries")
    visits = scratch.table(queries.mapInArrow(_hashed(largest, family.probes, *hashing), schema), "visits")
    found = _compared(visits, entries, queries, index, most, block_rows, scratch, "probed")

    # Queries that met fewer than they could are compared with all entries.
    enough = found.groupBy("query").agg(F.countDistinct("entry").alias("n")).where(F.col("n") >= min(most, n_entries or 0))
    short = queries.join(enough.select(F.col("query").alias("id")), "id", "left_anti")
    length = F.size("v").cast("long")
    rest = _compared(
        short.select("id", length.alias("bucket")), index.select("id", length.alias("bucket")),
        queries, index, most, block_rows, scratch, "compared",
    )

    scores = found.unionByName(rest).groupBy("query", "entry").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    scores = scores.withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= most).drop("at")
    listed = scores.join(members, "entry")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= most).select("query", "vec_id", "score")
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        asking.join(listed, "query")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
