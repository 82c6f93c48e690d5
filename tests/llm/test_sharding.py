"""The shards' law, groups and slots; the cuts against plain medians."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import awkward_docs, data, docs_frame

from salesloom.llm import sharding
from salesloom.llm.common import Scratch
from salesloom.llm.queries import QUERIES

POINTS = "bytes long, hash long, x0 long, x1 long, node long"


def plain_leaves(points, n):
    """Recursive cuts of a list of (bytes, hash, x0, x1) by sorting."""
    if n == 1 or not points:
        return {p: 0 for p in points}
    total = sum(p[0] for p in points)
    spread = sharding.COORDINATE_BITS - sharding.SPREAD_BITS
    variances = []
    for d in (2, 3):
        x = [p[d] >> spread for p in points]
        variances.append(total * sum(p[0] * v * v for p, v in zip(points, x)) - sum(p[0] * v for p, v in zip(points, x)) ** 2)
    d = 2 + variances.index(max(variances))
    points = sorted(points, key=lambda p: (p[d], p[1]))
    share, before, cut = total * (n // 2), 0, 0
    while cut < len(points) and (before + points[cut][0]) * n < share:
        before += points[cut][0]
        cut += 1
    if cut < len(points) and abs((before + points[cut][0]) * n - share) <= abs(before * n - share):
        cut += 1
    low, high = plain_leaves(points[:cut], n // 2), plain_leaves(points[cut:], n - n // 2)
    return low | {p: leaf + n // 2 for p, leaf in high.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13])
def test_leaves(spark, n):
    rng = random.Random(n)
    most = 1 << sharding.COORDINATE_BITS
    points = list({(rng.randint(1, 5000), rng.randrange(1 << 32), rng.choice([0, 7, most - 1, rng.randrange(most)]), rng.randrange(3) * 1000) for _ in range(700)})
    rows = sharding.leaves_of(spark.createDataFrame([(*p, 0) for p in points], POINTS), n, 2).collect()
    assert {(r.bytes, r.hash, r.x0, r.x1): r.node for r in rows} == plain_leaves(points, n)
    sizes = Counter()
    for r in rows:
        sizes[r.node] += r.bytes
    assert len(sizes) == n
    assert max(sizes.values()) - min(sizes.values()) <= 3 * 5000


def check_slots(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r)
    for members in slots.values():
        members.sort(key=lambda r: r.slot)
        assert [r.slot for r in members] == list(range(len(members)))
        ids = [math.inf if r.doc_id is None else r.doc_id for r in members]
        assert ids == sorted(ids)


def test_awkward_documents(spark):
    docs = awkward_docs()
    frame = docs_frame(spark, docs)
    result = sharding.shard(frame, shards=3)
    rows = result.collect()
    assert result.columns == [*frame.columns, "size", "shard", "slot"]
    assert sorted(str(r[:-3]) for r in rows) == sorted(str(r[:]) for r in frame.collect())
    assert all(r["size"] == len(data(r.text)) + 1 for r in rows)
    check_slots(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert set(sizes) == {0, 1, 2}


def test_column_names(spark):
    """Columns named like inner ones stay, those named like added ones are replaced."""
    docs = spark.createDataFrame(
        [(k, f"text {k}", "en", "s", 1, 2, 3, 4, 5, 6, 7) for k in range(20)],
        "doc_id long, text string, lang string, source string, row int, Digest int, node int, size int, shard int, slot int, d0 int",
    )
    rows = sharding.shard(docs, shards=2).collect()
    assert {(r.row, r.Digest, r.node, r.d0) for r in rows} == {(1, 2, 3, 7)}
    assert {r["size"] for r in rows} == {7, 8} and {r.shard for r in rows} == {0, 1}


def test_few_and_no_documents(spark):
    assert sharding.shard(docs_frame(spark, []), shards=8).count() == 0
    one = sharding.shard(docs_frame(spark, [(1, None, None, None, None, None, None, None)]), shards=8).collect()
    assert [(r["size"], r.slot) for r in one] == [(1, 0)]
    same = [(5, "the same text", "en", "s", None, None, None, None)] * 100
    rows = sharding.shard(docs_frame(spark, same), shards=4).collect()
    assert {r.shard for r in rows} == {0, 1, 2, 3}
    check_slots(rows)


def test_target_bytes(spark):
    docs = [(k, "x" * 99, "en", f"s{k % 7}", None, None, None, None) for k in range(64)]
    docs = [(k, f"{k:03d}" + t[3:], *rest) for k, t, *rest in docs]
    rows = sharding.shard(docs_frame(spark, docs), target_bytes=1600).collect()
    assert Counter(r.shard for r in rows) == {k: 16 for k in range(4)}


def test_groups_stay_together_unless_large(spark):
    rng = random.Random(4)
    docs = [(k, f"pair {k // 2} " + "w " * rng.randint(1, 40), f"l{k % 3}", f"s{k % 5}", None, None, None, None) for k in range(4000)]
    docs = [(k, docs[k // 2 * 2][1], *rest) for k, _, *rest in docs]
    docs += [(4000 + k, "one large group of copies " * 3, "en", "s1", None, None, None, None) for k in range(2000)]
    rows = sharding.shard(docs_frame(spark, docs), shards=8).collect()
    shards, sizes = defaultdict(set), Counter()
    for r in rows:
        shards[r.text].add(r.shard)
        sizes[r.shard] += r["size"]
    large = shards.pop(docs[-1][1])
    assert all(len(s) == 1 for s in shards.values())
    assert len(large) > 1
    assert max(sizes.values()) < 1.01 * min(sizes.values())


def test_dimensions(spark):
    rows = [(None, None, None, None), ("srcA", 1.0, 5, True), ("srcB", float("nan"), None, False), ("src", 3.0, 7, None)]
    frame = spark.createDataFrame(rows, "s string, f double, n long, b boolean")
    found = frame.select(*(x.alias(f"x{k}") for k, x in enumerate(sharding.coordinates(frame, ["s", "f", "n", "b"])))).collect()
    far = (1 << sharding.COORDINATE_BITS) - 1
    assert [r.x0 for r in found][0] == far and found[3].x0 == 0 and 0 < found[1].x0 < found[2].x0 <= far
    assert [r.x1 for r in found] == [far, 0, far, far]
    assert [r.x2 for r in found] == [far, 0, far, far]
    assert [r.x3 for r in found] == [far, far, 0, far]


def test_slots(spark):
    rows = [(k % 3, k) for k in range(1000)] + [(2, 0)] * 50
    frame = spark.createDataFrame(rows, "shard int, id long").repartition(7)
    found = sharding.numbered_within(frame, Scratch(spark, "slots"), "shard", [frame.id]).collect()
    for shard in range(3):
        members = sorted((r.id, r.slot) for r in found if r.shard == shard)
        assert sorted(s for _, s in members) == list(range(len(members)))
        assert [i for i, _ in sorted(members, key=lambda m: m[1])] == [i for i, _ in members]


def test_query(spark, small):
    docs = {r.doc_id: data(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    query = QUERIES["op11_sharding"](spark, small)
    assert [f"{n} {t}" for n, t in query.dtypes] == [
        "doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"
    ]
    plan = query._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = query.collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all((r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id])) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert sorted(sizes) == list(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    check_slots(rows)
    again = QUERIES["op11_sharding"](spark, small).collect()
    assert sorted(rows, key=str) == sorted(again, key=str)
