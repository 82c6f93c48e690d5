"""Fingerprints: exact columns against plain Python, estimates against full sets."""

import hashlib
import random

from llm_cases import docs_frame, words
from pyspark.sql import functions as F

from salesloom.llm import fingerprint
from salesloom.llm.queries import QUERIES


def shingle_set(text):
    found = words(text)
    width = min(5, len(found))
    return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)} if found else set()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def test_edited_texts(spark):
    rows = in_order([(r.doc_id, r.text or "") for r in docs_frame(spark).collect()])
    expected = sorted(
        str((d, len(t), t, edited(t, rows[(k + 1) % len(rows)][1]))) for k, (d, t) in enumerate(rows)
    )
    found = fingerprint.edited(docs_frame(spark)).select("doc_id", "n_chars", "text", "edited_text").collect()
    assert sorted(str(tuple(r)) for r in found) == expected


def test_query_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = in_order([(r.doc_id, r.text or "") for r in docs])
    found = {r.doc_id: r for r in QUERIES["op5_fingerprint"](spark, small).collect()}
    assert len(found) == len(rows)
    errors, by_text = [], {}
    for k, (d, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = edited(text, after)
        row = found[d]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        a, b = shingle_set(text), shingle_set(changed)
        if len(a | b) > 200:
            errors.append(abs(len(a & b) / len(a | b) - row.near_edited))
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.08


def test_sketches(spark):
    frame = spark.createDataFrame([("a b c d e f",), (" a  b\tc d e f\n",), ("",), (" \n",), ("a",), ("b",)], "text string")
    a, same, empty, blank, one, other = [r[0] for r in frame.select(fingerprint.sketch(F.col("text"))).collect()]
    assert a == same and a == sorted(a) and empty == blank == []
    assert len(one) == len(other) == 1 and one != other


def test_sketches_merge(spark):
    """The merged sketch of two texts' shingles is the sketch of all of them, short and long."""
    rng = random.Random(9)
    hashes = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([0, 1, 2, 5, 9, 60, 400]))] for _ in range(120)]
    rows = [(x, y + x[: rng.randint(0, 3)]) for x, y in zip(hashes, hashes[1:])]
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>")
    a, b = (fingerprint._kept(F.col(c), fingerprint.SCALE) for c in "xy")
    both = fingerprint._kept(F.concat("x", "y"), fingerprint.SCALE)
    for row in frame.select(a.alias("a"), b.alias("b"), both.alias("both"), fingerprint.merged(a, b).alias("merged")).collect():
        assert row.merged == row.both
        limit = -(2**63) + 2**64 // fingerprint.SCALE
        assert all(len(s) <= 1 or max(s) < limit for s in (row.a, row.b, row.both))


def test_containment_of_unequal_texts(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    part = " ".join(f"w{k}" for k in range(3_000, 5_000))
    frame = spark.createDataFrame([(long, part)], "x string, y string").select(
        fingerprint.sketch(F.col("x")).alias("x"), fingerprint.sketch(F.col("y")).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    row = frame.select(
        fingerprint.containment(y, x), fingerprint.containment(x, y), fingerprint.merged(x, y) == x, fingerprint.likeness(x, y)
    ).first()
    assert row[0] == 1 and abs(row[1] - 0.1) < 0.03 and row[2] and abs(row[3] - 0.1) < 0.03


def test_no_python_in_the_plan(spark, small):
    plan = QUERIES["op5_fingerprint"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty(spark):
    assert fingerprint.edited(docs_frame(spark, [])).count() == 0
