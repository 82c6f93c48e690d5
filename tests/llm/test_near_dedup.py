"""Near-dedup against all pairs, and its parts by their properties."""

import random
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import data, docs_frame, stored, words
from pyspark.sql import functions as F

from salesloom.llm import near_dedup, sketches
from salesloom.llm.common import Scratch


def shingle_set(text, width):
    found = [w.lower() for w in words(text)]
    if not found:
        return frozenset()
    width = min(width, len(found))
    return frozenset(tuple(found[k : k + width]) for k in range(len(found) - width + 1))


def groups(docs, width, percent):
    """doc_id -> smallest doc_id reachable, over all pairs."""
    sets = {}
    for doc_id, text in docs:
        if doc_id is not None:
            sets.setdefault(doc_id, set()).add(shingle_set(text, width))
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_awkward_documents(spark, tmp_path, width, percent):
    docs = stored(docs_frame(spark), tmp_path)
    expected = groups([(r.doc_id, r.text) for r in docs.collect()], width, percent)
    rows = near_dedup.link(docs, width, percent).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.component_id == (None if row.doc_id is None else expected[row.doc_id])
        assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)
    sizes = {(r.doc_id, r.n_shingles) for r in rows}
    assert sizes == {(r.doc_id, len(shingle_set(r.text, width))) for r in docs.collect()}
    kept = near_dedup.keep_one_each(docs, width, percent)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(set(expected.values()))


def test_chains_of_edits(spark, tmp_path):
    """Groups whose ends are unlike, so that no star reaches all of a bucket."""
    rng = random.Random(11)
    docs = []
    for group in range(6):
        text = [f"g{group}w{k}" for k in range(90)]
        for _ in range(40):
            text = list(text)
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            docs.append(" ".join(text))
    rng.shuffle(docs)
    rows = [(k, t, "en", "s", 1, None, None, None) for k, t in enumerate(docs)]
    frame = stored(docs_frame(spark, rows), tmp_path)
    expected = groups([(k, t) for k, t, *_ in rows], 3, 85)
    assert len(set(expected.values())) < 200
    assert {r.doc_id: r.component_id for r in near_dedup.link(frame, 3, 85).collect()} == expected


def test_pages_of_one_template_meet_nobody(spark, monkeypatch):
    """Pages that share 100 words and no more: what is compared grows with the pages, not with their pairs."""
    rng = random.Random(6)
    template = " ".join(f"t{k}" for k in range(100))
    compared = []
    real = near_dedup.linked_beside_stars

    def counted(members, texts, words, percent, scratch):
        of_key = members.groupBy("key").count().select(F.sum(F.col("count") * F.col("count"))).first()[0]
        compared.append((texts.count(), of_key or 0))
        return real(members, texts, words, percent, scratch)

    monkeypatch.setattr(near_dedup, "linked_beside_stars", counted)
    for n in (400, 800, 1600):
        pages = [template + "".join(f" p{k}w{rng.randrange(10**9)}" for _ in range(60)) for k in range(n)]
        pages += [pages[0] + " and a few words more", pages[1].replace("t50 ", "")]
        frame = spark.createDataFrame([(k, t) for k, t in enumerate(pages)], "doc_id long, text string").repartition(4)
        found = {r.doc_id: r.component_id for r in near_dedup.link(frame, 5, 80).collect()}
        assert found == {k: {n: 0, n + 1: 1}.get(k, k) for k in range(n + 2)}
    assert compared[-1][0] > 1000  # they do share buckets
    assert all(pairs <= 50 * asked for asked, pairs in compared)


def test_listed_shingles_meet_every_link():
    """Sets as alike as the threshold asks share a listed shingle, whatever the bitmaps hold."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)])
        shared = len(np.intersect1d(a, b))
        bits = [bytearray(rng.integers(0, 256, 1 << 12, dtype=np.uint8).tobytes()) for _ in range(2)]
        for h in np.intersect1d(a, b) >> np.uint64(16):  # shared shingles are known to be
            at = int(h) % (8 << 12)
            bits[0][at // 8] |= 1 << at % 8
        several, often = (sketches.Bitmap(bytes(x)) for x in bits)
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(near_dedup.listed(a, 80, several, often), near_dedup.listed(b, 80, several, often)))


def test_recall_against_all_pairs(spark):
    """Components of the query on sf0.1 against those over all pairs that are alike, found by their rarest shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: near_dedup.shingles(data(r.text), 3) for r in docs}
    everything, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    by_shingle, parent = defaultdict(list), {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, own in sets.items():
        rarest = own[np.lexsort((own, counts[np.searchsorted(everything, own)]))][: len(own) - -(-85 * len(own) // 100) + 1]
        for s in rarest.tolist():
            by_shingle[s].append(d)
    pairs = {(a, b) for ids in by_shingle.values() for k, b in enumerate(ids) for a in ids[:k]}
    linked = 0
    for a, b in pairs:
        shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
            linked += 1
    from salesloom.llm.queries import QUERIES

    found = {r.doc_id: r.component_id for r in QUERIES["op4_near_dedup"](spark, "/root/testdata/sf0.1").collect()}
    assert linked > 400
    assert found == {d: root(d) for d in sets}


def test_sf_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    expected = groups([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    from salesloom.llm.queries import QUERIES

    found = {r.doc_id: r.component_id for r in QUERIES["op4_near_dedup"](spark, tiny).collect()}
    assert found == expected


def test_empty(spark, tmp_path):
    assert near_dedup.link(stored(docs_frame(spark, []), tmp_path)).count() == 0


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    for size in (12, 60, 600):
        agree = []
        for _ in range(60):
            both = rng.integers(0, 2**63, size * 8 // 10, dtype=np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, size // 10, dtype=np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, size // 10, dtype=np.uint64)]))
            agree.append((near_dedup.signature(a, 120) == near_dedup.signature(b, 120)).mean())
            alike = len(both) / len(np.union1d(a, b))
        assert abs(np.mean(agree) - alike) < 0.05


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.doc_id: r.component for r in near_dedup.components(frame, Scratch(spark, "test"), "links").collect()}
    assert found == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert near_dedup.components(frame.limit(0), Scratch(spark, "test"), "links").count() == 0
