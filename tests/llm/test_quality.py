"""The Kneser-Ney model against a plain one, and the classifier by what it keeps."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_frame, stored, words
from pyspark.sql import functions as F

from salesloom.llm import quality
from salesloom.llm.common import Scratch
from salesloom.llm.sketches import bitmap_over


def plain_model(texts):
    """log probabilities of a text's words by interpolated modified Kneser-Ney."""
    counts3 = Counter()
    for text in texts:
        ws = ["<", "<", *words(text), ">"]
        counts3.update(zip(ws, ws[1:], ws[2:]))
    counts2 = Counter((v, w) for _, v, w in counts3)
    counts1 = Counter((w,) for _, w in counts2)

    def weights(counts):
        n1, n2, n3, n4 = (max(1, sum(1 for c in counts.values() if c == k)) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        ds = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        ds = [min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), ds)]
        total, free = Counter(), defaultdict(float)
        for gram, c in counts.items():
            total[gram[:-1]] += c
            free[gram[:-1]] += ds[min(c, 3) - 1]
        a = {g: (c - ds[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items()}
        return a, {g: free[g] / total[g] for g in total}

    (a3, g3), (a2, g2), (a1, g1) = map(weights, (counts3, counts2, counts1))

    def log(text):
        ws = ["<", "<", *words(text), ">"]
        return [
            math.log(a3.get((u, v, w), 0) + g3.get((u, v), 1) * (a2.get((v, w), 0) + g2.get((v,), 1) * (a1.get((w,), 0) + g1[()] / quality.VOCABULARY)))
            for u, v, w in zip(ws, ws[1:], ws[2:])
        ]

    return log


def test_model_equals_a_plain_one(spark):
    texts = ["a b c a b d a b c", "b c a a b", "x", "", "the a b c the a b"]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "bytes binary")
    weights = quality.train(frame, Scratch(spark, "test")).toArrow()
    model = quality.sharded(weights.column("key").to_numpy().view(np.uint64), weights.column("weight").to_numpy())
    log = plain_model(texts)
    asked = [b"a b c", b"a b z q", b"", b"the a b d", b"x x"]
    found = quality.perplexities(asked, model)
    for text, value in zip(asked, found):
        if not text:
            assert value is None
            continue
        assert value == pytest.approx(math.exp(-np.mean(log(text.decode()))), rel=1e-9)


def test_probabilities_add_up(spark):
    texts = ["a b c a b d a b c", "b c a a b", "c c d"]
    log = plain_model(texts)
    known = {w for t in texts for w in words(t)}
    # After "a b": all known words, the end, and as much for each other word of the vocabulary.
    total = sum(math.exp(log("a b " + w.decode())[2]) for w in known) + math.exp(log("a b")[2])
    total += (quality.VOCABULARY - len(known) - 1) * math.exp(log("a b zz")[2])
    assert total == pytest.approx(1, abs=1e-6)


def test_keeps_good_and_rejects_bad_documents(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = quality.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in judged.collect()}
    assert kept[1] > 0.96
    assert kept[0] < 0.5


def test_sample_is_whole_texts_by_words_together(spark, tmp_path, monkeypatch):
    """Long documents are trained on like others, until the sample has its words."""
    docs = [(k, "w " * (5000 if k % 9 == 0 else 10), "en", "s", 1, None, None, None) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda texts, scratch: seen.append(texts.collect()) or train(texts, scratch))
    frame = stored(docs_frame(spark, docs), tmp_path)
    for limit in (60_000, 10**9):
        quality.judge(frame, labels, train_words=limit).count()
    few, everything = ([len(words(bytes(r.bytes).decode())) for r in rows] for rows in seen)
    assert {10, 5000} == set(few) == set(everything)
    assert sum(few) - 5000 < 60_000 <= sum(few) < sum(everything)
    assert len(everything) == sum(r.out is False for r in labels.select((F.pmod(quality._draw(), F.lit(quality.HELD_OUT)) == 0).alias("out")).collect())


def test_verdicts_follow_a_plain_form(spark, small):
    """Thresholds are the languages' quantiles of held-out trusted documents; above them documents go."""
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.judge(docs, labels).collect()
    trusted = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    out = {r.doc_id for r in labels.select("doc_id", (F.pmod(quality._draw(), F.lit(quality.HELD_OUT)) == 0).alias("out")).collect() if r.out}
    by_language = defaultdict(list)
    for r in rows:
        if r.doc_id in trusted & out and r.perplexity is not None:
            by_language[r.lang].append(r.perplexity)
    everything = sorted(sum(by_language.values(), []))

    def quantile(values):
        return sorted(values)[max(math.ceil(quality.QUANTILE * len(values)) - 1, 0)]

    assert everything
    for r in rows:
        most = quantile(by_language.get(r.lang) or everything)
        assert r.most == pytest.approx(most)
        assert r.kept == (r.perplexity is None or r.perplexity <= r.most)
    assert 0 < sum(not r.kept for r in rows) < len(rows) / 2


def test_awkward_documents(spark, tmp_path):
    docs = stored(docs_frame(spark), tmp_path)
    labels = spark.createDataFrame(
        [(k * 3, k % 2, 0 if k % 5 else 1, "x") for k in range(60)] + [(None, 1, 0, None), (9, None, None, None), (9, 1, 0, None), (10**9, 1, 0, None)],
        "doc_id long, quality int, toxic int, text string",
    )
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.kept for r in rows if r.perplexity is None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)


def test_empty(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(stored(docs_frame(spark, []), tmp_path), labels).count() == 0
    docs = stored(docs_frame(spark), tmp_path)
    assert quality.keep_good(docs, labels).count() == docs.count()


def test_whole_training(spark, tmp_path, monkeypatch):
    """Every trusted document that is not held out is trained on, beyond the 4,000 and 1.5 million words of old."""
    docs = [(k, "w " * (2000 if k % 5 == 0 else 3) + f"x{k}", "en", "s", 1, None, None, None) for k in range(6000)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6000)], "doc_id long, quality int, toxic int")
    seen = []

    def trained(texts, scratch):
        seen.extend(texts.select("doc_id", F.regexp_count(F.col("bytes").cast("string"), F.lit("[^ ]+")).alias("n")).collect())
        return texts.sparkSession.createDataFrame([], quality.MODEL)

    monkeypatch.setattr(quality, "train", trained)
    quality.judge(stored(docs_frame(spark, docs), tmp_path), labels)
    out = {r.doc_id for r in labels.where(F.pmod(quality._draw(), F.lit(quality.HELD_OUT)) == 0).collect()}
    assert sorted(r.doc_id for r in seen) == [k for k in range(6000) if k not in out]
    assert len(seen) > 4000 and sum(r.n for r in seen) > 1_500_000


def test_chunks_equal_a_plain_model(spark, small):
    """Perplexities from a model joined to many chunks, in rounds, are those of a model in one place."""
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    trusted = labels.where("quality = 1 AND toxic = 0").where(F.pmod(quality._draw(), F.lit(quality.HELD_OUT)) != 0)
    trained = {r.doc_id for r in trusted.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    log = plain_model([text for doc_id, text in texts.items() if doc_id in trained])
    rows = quality.judge(docs, labels, chunk_bytes=200_000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if not words(texts[r.doc_id]):
            assert r.perplexity is None
        else:
            assert r.perplexity == pytest.approx(math.exp(-np.mean(log(texts[r.doc_id]))), rel=1e-5)


def test_quantiles_are_exact(spark):
    """Beyond the sketch's accuracy, with values that come often."""
    values = [("a", float(k * k % 30_011)) for k in range(30_000)] + [("b", 1.0)] * 50 + [("b", 2.0)] + [(None, 3.0)]
    found = quality.quantiles(spark.createDataFrame(values, "of string, perplexity double"), 0.98).collect()
    a = sorted(v for of, v in values if of == "a")
    assert {r.of: r.most for r in found} == {"a": a[math.ceil(0.98 * len(a)) - 1], "b": 1.0, None: 3.0}


def test_model_is_shuffled_once(spark, small):
    """The rounds' joins read the model's buckets as they lie: what is shuffled is rows asked, and no model row twice."""
    docs, scratch = spark.read.parquet(f"{small}/documents.parquet").limit(200), Scratch(spark, "test")
    weights = quality.train(docs.select(F.col("text").cast("binary").alias("bytes")), scratch)
    with quality.bucketed(weights, scratch) as model:
        found = {r.gram: r for r in model.collect()}
        keys = {r.key: r for r in weights.collect()}
        assert sum((r.weight is not None) + (r.left is not None) for r in found.values()) == len(keys)
        asked = spark.range(100_000).select(F.col("id").alias("gram")).hint("merge")
        plan = asked.join(model.hint("shuffle_hash"), "gram")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(gram") <= 1 and "Bucketed: true" in plan
    assert not spark.catalog.listTables(pattern="salesloom_quality_*")


def test_asks_for_what_the_model_can_have(spark):
    """Without a bitmap that is full, a chunk asks for no trigram, pair or word that the model lacks."""
    weights = quality.train(spark.createDataFrame([(b"a b c",)], "bytes binary"), Scratch(spark, "test"))
    grams = weights.select(F.when(F.col("kind") < 0, F.col("key").bitwiseXOR(F.lit(int(quality.END)))).otherwise(F.col("key")).alias("gram"))
    content = spark.sparkContext.broadcast(bitmap_over(grams, 20))
    chunk = pa.table({"chunk": [7], "bytes": pa.array([b"x a b y z " + b"q r s " * 50], pa.binary())})
    asked = quality._asking(content)(chunk)
    # "a", "b", "a b", the beginning as contexts, the end, and what is left to unknown words.
    (uvw, vw, w, uv_, v_), _ = quality.keys_of([b"a b"])
    expected = {0, *(int(k) for k in (w.view(np.int64)[[0, 1, 2]])), int(vw.view(np.int64)[1])}
    expected |= {int((uv_ ^ quality.END).view(np.int64)[0]), int((v_ ^ quality.END).view(np.int64)[0])}
    assert set(asked.column("gram").to_pylist()) == expected
    assert set(asked.column("chunk").to_pylist()) == {7}
