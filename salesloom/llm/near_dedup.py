"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

Documents are sets of word shingles. Those of one and the same set form a class, and one
row of each class goes on. A single pass over its shingles' hashes fills a signature's
bins with their least values; an empty bin takes the value of the first filled one on a
sequence of bins that only depends on its own number (optimal densification), so two
sets agree in a bin as often as they are alike. Bands of bins are buckets, and every
bucket links its members to its smallest one, a star, instead of to each other.

A star's edges are confirmed on full sets: texts are joined to the pairs and compared.
Where a bucket's members then still belong to more than one component, what its star
could not see may link them. These documents are compared again, but not all with all:
two of them can only be linked if they share one of their rarest shingles, of which each
lists as many as it may differ by and one more. What is rare is told by bitmaps of
bounded size (see `sketches`); they only order the shingles, so that any order they give
finds every link. Shingles of one document alone bring nobody together, so pages that
share a long template and nothing else are compared with nobody. Who shares a listed
shingle falls into blocks of bounded size; each two blocks meet in one cell, which counts
what documents of different components share and tells only the links. So a hot group
that one star settles costs as many rows as it has members, and only pairs that share no
bucket at all can be missed: of sets as large as the signature about one in a million at
the threshold, more of very small ones, where tests measure it.

Null texts and texts without words have the empty set, are linked with nothing and kept.
Fewer words than a shingle's make one shingle. Rows that share a doc_id are one
document, linked with what any of its texts is like. Rows without a doc_id are linked
with nothing and kept; their component is null. Other columns take no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, free_name, mix, numbered, text_bytes, windows_of, word_hashes
from salesloom.llm.sketches import HASH_BITS, SKETCH, Bitmap, bitmap_of, ranges_for, sketched

WORDS = 5
PERCENT = 80
BANDS, ROWS = 24, 5
#: Documents of a block that share a key, meetings of a shard, and columns of a count at a time.
BLOCK_DOCS, SHARD_MEETINGS, COLUMNS = 256, 4000, 4096
#: Documents from which a shingle counts as frequent; shingles that a task sorts at once.
OFTEN, MOST_HASHES = 32, 1 << 22


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z lower-cased."""
    return np.unique(windows_of(word_hashes(text.lower().split()), words))


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a set that is not empty, with optimal densification."""
    hashes = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bin_of = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bin_of.astype(np.int64), mix(hashes))
    filled = np.zeros(bins, dtype=bool)
    filled[bin_of.astype(np.int64)] = True
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty):
        # Where an empty bin looks next depends on its number and the attempt alone.
        attempt += 1
        look = mix(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)
        hit = filled[look.astype(np.int64)]
        least[empty[hit]] = least[look[hit].astype(np.int64)]
        empty = empty[~hit]
    return least


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A bucket number for each band; bands differ, so buckets of different bands do too."""
    grouped = signature.reshape(bands, rows)
    keys = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
    return keys.view(np.int64)


def _signed(words: int, bands: int, rows: int):
    numbers = [(name, pa.int64()) for name in ("doc_id", "row", "n_shingles", "set_a", "set_b")]
    schema = pa.schema([*numbers, ("keys", pa.list_(pa.int64()))])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, set_a, set_b, keys = [], [], [], []
            for text in batch.column("bytes").to_pylist():
                own = shingles(text, words)
                n.append(len(own))
                # Sums of scrambled hashes name the set, in any order of its shingles.
                set_a.append(mix(own).sum(dtype=np.uint64).astype(np.int64) if len(own) else 0)
                set_b.append(mix(own ^ np.uint64(0xC3C3C3C3C3C3C3C3)).sum(dtype=np.uint64).astype(np.int64) if len(own) else 0)
                keys.append(band_keys(signature(own, bands * rows), bands, rows) if len(own) else np.empty(0, dtype=np.int64))
            made = [pa.array(c, pa.int64()) for c in (n, set_a, set_b)]
            columns = [batch.column("doc_id"), batch.column("row"), *made, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return signed


def _alike(words: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("together", pa.int64())])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[int]] = [[], [], [], []]
            last_text, last_set = None, None
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if x != last_text:
                    last_text, last_set = x, shingles(x, words)
                other = shingles(y, words)
                shared = len(np.intersect1d(last_set, other, assume_unique=True))
                together = len(last_set) + len(other) - shared
                if 100 * shared >= percent * together:
                    for column, value in zip(rows, (a, b, shared, together)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    return alike


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` whose full shingle sets are alike enough, with both counts."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("bytes").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("bytes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_alike(words, percent), "a long, b long, shared long, together long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, component) of every node on an edge (a, b): the smallest node reachable.

    Large and small stars in turn: every node's larger neighbours move to its smallest
    neighbour, then every node and its smaller neighbours do. Rounds grow with the
    logarithm of the longest path. Groups are never gathered; only minima are.
    """
    links = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct()
    links = scratch.table(links, f"{name}-0")
    for turn in itertools.count(1):
        ends = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # Large star: each larger neighbour of a node to the smallest of node and neighbours.
        least = ends.groupBy(F.col("low").alias("node")).agg(F.least(F.min("high"), F.min("low")).alias("least"))
        large = links.join(least, links["low"] == least["node"]).select("least", "high").where("least < high")
        # Small star: a node and its smaller neighbours to the smallest of them.
        large = large.distinct()
        small = large.groupBy("high").agg(F.min("least").alias("smallest"))
        moved = large.join(small, "high").where(F.col("least") > F.col("smallest")).select(
            F.col("smallest").alias("low"), F.col("least").alias("high")
        )
        fresh = small.select(F.col("smallest").alias("low"), "high").unionByName(moved).distinct()
        fresh = scratch.table(fresh, f"{name}-{turn}")
        # Stars only: nobody is both a centre and a leaf, and every leaf has one centre.
        chained = fresh.join(fresh.select(F.col("high").alias("low")).distinct(), "low", "left_semi").limit(1).count()
        scratch.remove(f"{name}-{turn - 1}")
        links = fresh
        if not chained:
            several = links.groupBy("high").count().where("count > 1").limit(1).count()
            if not several:
                break
    leaves = links.select(F.col("high").alias("doc_id"), F.col("low").alias("component"))
    centres = links.select(F.col("low").alias("doc_id"), F.col("low").alias("component")).distinct()
    return leaves.unionByName(centres)


def shared_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `first` shares with each of `second`."""
    if len(first) * len(second) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in second] for x in first])
    both = first + second
    values, place, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    # Shingles of one set only are shared with nobody; the others are columns, some at a time.
    column = np.cumsum(count > 1) - 1
    several = count[place] > 1
    row, place = row[several], column[place[several]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total = np.zeros((len(first), len(second)), dtype=np.float32)
    for start in range(0, int((count > 1).sum()), COLUMNS):
        now = slice(*np.searchsorted(place, [start, start + COLUMNS]))
        holds = np.zeros((len(both), COLUMNS), dtype=np.float32)
        holds[row[now], place[now] - start] = 1
        total += holds[: len(first)] @ holds[len(first) :].T
    return total.astype(np.int64)


def _linked_in_cells(words: int, percent: int):
    """Links between documents of different components that meet in a cell of the shard."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(shard: pa.Table) -> pa.Table:
        ids, component = (shard.column(c).to_numpy() for c in ("doc_id", "component"))
        sets = [shingles(text, words) for text in shard.column("bytes").to_pylist()]
        size = np.array([len(x) for x in sets])
        cells: dict[int, tuple[list[int], list[int]]] = {}
        for k, meetings in enumerate(shard.column("meetings").to_pylist()):
            for meeting in meetings:
                cells.setdefault(meeting["cell"], ([], []))[meeting["side"]].append(k)
        found = set()
        for first, second in cells.values():
            second = second or first  # a block that meets itself
            x, y = np.array(first), np.array(second)
            possible = (component[x][:, None] != component[y]) & (
                100 * np.minimum(size[x][:, None], size[y]) >= percent * np.maximum(size[x][:, None], size[y])
            )
            rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
            if not len(rows):
                continue
            x, y, possible = x[rows], y[columns], possible[np.ix_(rows, columns)]
            shared = shared_counts([sets[k] for k in x], [sets[k] for k in y])
            together = size[x][:, None] + size[y] - shared
            for k, m in zip(*np.nonzero(possible & (100 * shared >= percent * together))):
                found.add((min(ids[x[k]], ids[y[m]]), max(ids[x[k]], ids[y[m]])))
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return linked


def _shingle_sketch(words: int, ranges: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []

        def taken() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *met]), return_counts=True)
            met.clear()
            return sketched(found, counts, ranges, OFTEN)

        for batch in batches:
            for text in batch.column("bytes").to_pylist():
                met.append(shingles(text, words) >> np.uint64(64 - HASH_BITS))
            if sum(map(len, met)) > MOST_HASHES:
                yield taken()
        yield taken()

    return sketch


def listed(own: np.ndarray, percent: int, several: Bitmap, often: Bitmap) -> np.ndarray:
    """Of a set the rarest shingles, without which it can't reach the threshold; those of one document left out."""
    known = own >> np.uint64(64 - HASH_BITS)
    shared, common = several.holds(known), often.holds(known)
    order = np.lexsort((own, shared.astype(np.int8) + (shared & common)))
    first = order[: len(own) - -(-percent * len(own) // 100) + 1]
    return own[first[shared[first]]]


def _listed(words: int, percent: int, several: Broadcast, often: Broadcast):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, frequent = Bitmap(several.value), Bitmap(often.value)
        for batch in batches:
            found = [listed(shingles(text, words), percent, rare, frequent) for text in batch.column("bytes").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            keys = np.concatenate(found).view(np.int64) if found else np.empty(0, dtype=np.int64)
            columns = [pa.array(keys), *(batch.column(c).take(of) for c in ("doc_id", "component"))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "component"])

    return keys


def sharing(waiting: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(key, doc_id, component) of each listed shingle of documents in (doc_id, component, bytes)."""
    context = waiting.sparkSession.sparkContext
    ranges = ranges_for(waiting.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0)
    sketches = scratch.table(waiting.select("bytes").mapInArrow(_shingle_sketch(words, ranges), SKETCH), "sketches")
    several, often = (context.broadcast(bitmap_of(sketches, ranges, least, scratch, f"met-{least}")) for least in (2, OFTEN))
    return waiting.mapInArrow(_listed(words, percent, several, often), "key long, doc_id long, component long").distinct()


def linked_beside_stars(members: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of linked documents that share a key, from (key, doc_id, component)."""
    group = [F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest")]
    group += [F.bit_xor(F.xxhash64("doc_id")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b")]
    held = members.groupBy("key").agg(*group, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    # Of the keys that the same documents share one will do.
    held = held.groupBy("n", "least", "greatest", "a", "b").agg(F.min("key").alias("key"))
    held = scratch.table(held.select("key", "least", F.ceil(F.col("n") / BLOCK_DOCS).alias("blocks")), "held")
    placed = members.join(held, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ends = F.least("block", "other"), F.greatest("block", "other")
    # Keys of like groups share their least member, and so their shards.
    meetings = placed.select(
        "doc_id", "component", F.xxhash64("least", *ends).alias("place"),
        F.struct(F.xxhash64("key", *ends).alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("side")).alias("meeting"),
    )
    meetings = scratch.table(meetings, "meetings")
    shards = max(1, meetings.count() // SHARD_MEETINGS)
    asked = meetings.groupBy(F.pmod("place", F.lit(shards)).alias("shard"), "doc_id", "component").agg(
        F.collect_list("meeting").alias("meetings")
    )
    return asked.join(texts, "doc_id").groupBy("shard").applyInArrow(_linked_in_cells(words, percent), "a long, b long")


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row a document: row, doc_id, n_shingles, component_id, kept, first_row.

    Documents are linked if they share `percent` of their shingles or more. `row` is the
    row's place in the table; `first_row` marks the first one of each doc_id.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    placed = numbered(docs.select("doc_id", text_bytes().alias("bytes")))
    signed = placed.select("doc_id", "bytes", "row").mapInArrow(
        _signed(words, bands, rows), "doc_id long, row long, n_shingles long, set_a long, set_b long, keys array<long>"
    )
    signed = scratch.table(signed, "signed")

    sets = ["n_shingles", "set_a", "set_b"]
    named = signed.where("doc_id is not null and n_shingles > 0")
    # A class of equal sets is its smallest document, with the links of the others to it.
    # Written, so that the join splits a large class.
    classes = named.groupBy(*sets).agg(F.min("doc_id").alias("class"), F.max("doc_id").alias("other")).where("class < other")
    classes = scratch.table(classes.drop("other"), "classes")
    of_class = named.select("doc_id", *sets, "keys").join(classes, sets, "left")
    of_class = scratch.table(of_class.select("doc_id", "n_shingles", "keys", F.coalesce("class", "doc_id").alias("class")), "of-class")
    copies = of_class.where(F.col("doc_id") != F.col("class"))
    edges = scratch.table(copies.select(F.col("class").alias("a"), F.col("doc_id").alias("b")), "edges-copies")

    ones = of_class.where(F.col("doc_id") == F.col("class"))
    buckets = ones.select("doc_id", "n_shingles", F.explode("keys").alias("key")).distinct()
    shared = buckets.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("other")).where("centre < other")
    members = scratch.table(buckets.join(shared.drop("other"), "key"), "members")
    wanted = members.select("doc_id").distinct()
    texts = scratch.table(placed.select("doc_id", "bytes").join(wanted, "doc_id", "left_semi"), "texts")

    pairs = members.where(F.col("doc_id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    found = scratch.table(confirmed(pairs.distinct(), texts, words, percent).select("a", "b"), "edges-stars")
    edges = edges.unionByName(found)
    joined = components(edges, scratch, "stars")

    # Centres have met all their bucket.
    waiting = members.where(F.col("doc_id") != F.col("centre")).select("key", "doc_id").join(joined, "doc_id", "left")
    waiting = scratch.table(waiting.withColumn("component", F.coalesce("component", "doc_id")), "waiting")
    undecided = waiting.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    undecided = scratch.table(undecided.select("key"), "undecided")
    asked = waiting.join(undecided, "key", "left_semi").select("doc_id", "component").distinct()
    asked = scratch.table(texts.join(asked, "doc_id").select("doc_id", "component", "bytes"), "asked")
    beside = scratch.table(sharing(asked, words, percent, scratch), "listed")
    beside = scratch.table(linked_beside_stars(beside, asked.drop("component"), words, percent, scratch), "edges-beside")
    scratch.remove("members", "waiting", "undecided", "asked", "listed", "sketches", "held", "meetings", "texts")
    joined = components(joined.select(F.col("component").alias("a"), F.col("doc_id").alias("b")).unionByName(beside), scratch, "all")

    first = signed.groupBy("doc_id").agg(F.min("row").alias("first"))
    return (
        signed.select("row", "doc_id", "n_shingles")
        .join(joined, "doc_id", "left")
        .join(first, "doc_id", "left")
        .select(
            "row", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
            (F.col("doc_id").isNull() | (F.col("row") == F.col("first"))).alias("first_row"),
        )
    )


def keep_one_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, one of each component; `docs` is read twice, in the same order."""
    row = free_name(docs, "row")
    kept = link(docs, words, percent).where("kept and first_row").select(F.col("row").alias(row))
    return numbered(docs, row).join(kept, row, "left_semi").drop(row)
