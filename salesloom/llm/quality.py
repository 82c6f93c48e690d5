"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is trained on whole trusted documents, labelled good and not toxic: on three in
four of them by a hash of their ids, however many they are. A text's perplexity is
compared with a quantile of those of its own language, taken over the other trusted
documents, which the model has not seen; above it the document is rejected. A language
without such documents takes the quantile of all of them. Quantiles are exact.

Counts, continuation counts, contexts and discounts are aggregates and windows that are
sharded by context. What they give is one weight a n-gram and one a context, so that
a word's probability is

    a3 + g3 * (a2 + g2 * (a1 + g1 / VOCABULARY))

with a = 0 for an unknown n-gram and g = 1 for an unknown context. The model stays a table,
in buckets by hash. Documents are dealt into chunks of bounded size; a chunk asks for its
distinct words, pairs and trigrams by rows that are joined to the model's buckets, which are
shuffled once for all chunks. A bitmap of bounded size leaves out what the model can't have;
once it fills up, rows are asked in vain and no result changes. The weights go back to the
chunk, which sums its documents' logarithms. Chunks come in `ROUNDS`, and a round's shuffles
go at its end, so that the disk holds a share of them.

An n-gram's name is the hash of its first word and, rotated, the name of the rest; a
context's name has some bits turned.

Words are runs of other bytes than white space, as they are written. Null texts and
texts without words have no perplexity and are not rejected. A null language is a
language. Labels without a document, and repeated labels, change nothing; a document with
several labels is trusted if all are good. Other columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import WORD, Scratch, free_name, numbered, partitions, shuffles_removed, text_bytes, word_hashes
from salesloom.llm.sketches import Bitmap, bitmap_over

#: Share of trusted documents that are never trained on.
HELD_OUT = 4
QUANTILE = 0.98
#: A sketch tells a quantile's surroundings to one in so many ranks.
ACCURACY = 10_000
#: Words that there could be, each as likely where nothing else is known.
VOCABULARY = 10_000_000
#: Bytes of text behind one chunk, and the rounds that chunks come in.
CHUNK_BYTES, ROUNDS = 2 << 20, 4
#: The model's rows behind one bucket, and the most buckets that Spark allows.
BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 100_000
#: Texts whose trigrams are counted together before they are shuffled.
COUNTED_TEXTS = 1_000
TURN = 23
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

MODEL = "key long, weight double, kind byte"
ASKED = "chunk long not null, gram long not null"
SCORED = "doc_id long, row long, lang string, perplexity double"


def _before(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Names of n-grams from those of their first words and of the rest."""
    return first ^ (rest << np.uint64(TURN) | rest >> np.uint64(64 - TURN))


def _name(context: Column, word: Column, length: int) -> Column:
    """The same in a table: of an n-gram, from the name of all but its last word and that word."""
    for _ in range(length - 1):
        word = F.shiftleft(word, TURN).bitwiseOR(F.shiftrightunsigned(word, 64 - TURN))
    return context.bitwiseXOR(word) if length > 1 else word


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words one after the other, each text between two marks and one; where its words and its
    end are; how many these are in each text."""
    split = [text.split() for text in texts]
    n_words = np.array([len(words) for words in split], dtype=np.int64)
    places = np.arange(n_words.sum()) + 3 * np.repeat(np.arange(len(texts)), n_words) + 2
    ends = np.cumsum(n_words + 3) - 1
    run = np.full(n_words.sum() + 3 * len(texts), BEGIN)
    run[places], run[ends] = word_hashes([word for words in split for word in words]), END
    return run, np.sort(np.concatenate([places, ends])), n_words + 1


def keys_of(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Names of u v w, of v w, of w, and of the contexts u v and v, for each word and end; how many these are in each text."""
    run, at, lengths = padded(texts)
    twos = _before(run[:-1], run[1:])
    return [_before(run[at - 2], twos[at - 1]), twos[at - 1], run[at], twos[at - 2] ^ END, run[at - 1] ^ END], lengths


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams u v w, each once for some texts, with its count there; u and v go by the name of both."""
    for batch in batches:
        for start in range(0, batch.num_rows, COUNTED_TEXTS):
            run, at, _ = padded(batch.column(0).slice(start, COUNTED_TEXTS).to_pylist())
            twos = _before(run[:-1], run[1:])
            names = _before(run[at - 2], twos[at - 1])
            order = np.argsort(names)
            starts = np.flatnonzero(_new(names[order]))
            at = at[order[starts]]
            columns = [twos[at - 2].view(np.int64), run[at - 1].view(np.int64), run[at].view(np.int64), np.diff(starts, append=len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=["uv", "v", "w", "n"])


def _new(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of n-grams counted once, twice and more often."""
    have = dict(counts.where("n <= 4").groupBy("n").agg(F.count("*")).collect())
    n1, n2, n3, n4 = (max(1, have.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.1), k - 0.1) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _sums() -> dict[str, Column]:
    n = F.col("n")
    return {"total": F.sum("n"), "ones": F.count_if(n == 1), "twos": F.count_if(n == 2), "more": F.count_if(n > 2)}


def _in_context(counts: DataFrame, context: str) -> DataFrame:
    """n of words w, with what their context has in all; one row of each context is its `first`."""
    having = Window.partitionBy(context)
    sums = [column.over(having).alias(name) for name, column in _sums().items()]
    return counts.select("*", *sums, (F.col("w") == F.min("w").over(having)).alias("first"))


def _weights(counts: DataFrame, length: int) -> DataFrame:
    """(key, weight, kind) of n-grams and of their contexts, from their counts in their context, the first column.

    The kind is the number of words, below zero for contexts.
    """
    context = F.col(counts.columns[0])
    ds = discounts(counts)
    n = F.col("n")
    discount = F.when(n == 1, ds[0]).when(n == 2, ds[1]).otherwise(ds[2])
    key = _name(context, F.col("w"), length).alias("key")
    grams = counts.select(key, ((n - discount) / F.col("total")).alias("weight"), F.lit(length).cast("byte").alias("kind"))
    left = (sum(F.lit(d) * F.col(name) for d, name in zip(ds, ("ones", "twos", "more"))) / F.col("total")).alias("weight")
    key = context.bitwiseXOR(F.lit(int(END))) if length > 1 else F.lit(0).cast("long")
    return grams.unionByName(counts.where("first").select(key.alias("key"), left, F.lit(1 - length).cast("byte").alias("kind")))


def train(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, weight, kind) of the model, from texts in column `bytes`; key 0 holds what is left to unknown words.

    It reads the tables counts-1, counts-2 and counts-3.
    """
    with shuffles_removed(scratch.spark):
        words = texts.select("bytes").mapInArrow(_exploded, "uv long, v long, w long, n long").repartition("uv")
        three = scratch.table(_in_context(words.groupBy("uv", "v", "w").agg(F.sum("n").alias("n")), "uv"), "counts-3")
        # Lower orders count the different words before an n-gram.
        two = scratch.table(_in_context(three.groupBy("v", "w").agg(F.count("*").alias("n")), "v"), "counts-2")
        one = scratch.table(two.groupBy("w").agg(F.count("*").alias("n")), "words")
        totals = one.agg(*(column.alias(name) for name, column in _sums().items()), F.min("w").alias("least")).where("total > 0")
        one = scratch.table(one.crossJoin(F.broadcast(totals)).withColumn("first", F.expr("w = least")), "counts-1")
    return _weights(three, 3).unionByName(_weights(two, 2)).unionByName(_weights(one, 1))


def sharded(keys: np.ndarray, weights: np.ndarray) -> tuple[pd.Index, np.ndarray]:
    """The weights by their keys, which a hash table finds."""
    return pd.Index(keys.view(np.int64)), weights


def look_up(model: tuple[pd.Index, np.ndarray], keys: np.ndarray, otherwise: float) -> np.ndarray:
    """Joins keys to the model's weights."""
    known, weights = model
    if not len(known):
        return np.full(len(keys), otherwise)
    place = known.get_indexer(keys.view(np.int64))
    return np.where(place < 0, otherwise, weights[place])


def log_probabilities(model: tuple[pd.Index, np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    a3, a2, a1 = (look_up(model, k, 0.0) for k in keys[:3])
    g3, g2 = (look_up(model, k, 1.0) for k in keys[3:])
    unknown = look_up(model, np.zeros(1, dtype=np.uint64), 1.0)[0]
    return np.log(a3 + g3 * (a2 + g2 * (a1 + unknown / VOCABULARY)))


def perplexities(texts: list[bytes], model: tuple[pd.Index, np.ndarray]) -> list[float | None]:
    """exp of the mean negative log probability of a text's words and its end; None without words."""
    keys, lengths = keys_of(texts)
    sums = np.add.reduceat(log_probabilities(model, keys), np.cumsum(lengths) - lengths)
    return [float(np.exp(-s / n)) if n > 1 else None for s, n in zip(sums, lengths)]


def _asking(content: Broadcast):
    """Words, pairs and trigrams, as such or as contexts, that the model can have, and what is left to unknown words."""

    def asking(chunk: pa.Table) -> pa.Table:
        (uvw, vw, w, uv_, v_), _ = keys_of(chunk.column("bytes").to_pylist())
        held = Bitmap(content.value)
        uv, v = uv_ ^ END, v_ ^ END
        pairs, contexts = held.holds(vw), held.holds(uv)
        uvw = uvw[pairs & contexts]
        asked = [uvw[held.holds(uvw)], vw[pairs], uv[contexts], w[held.holds(w)], v[held.holds(v)], np.zeros(1, dtype=np.uint64)]
        grams = np.sort(np.concatenate(asked))
        grams = grams[_new(grams)].view(np.int64)
        return pa.table({"chunk": np.full(len(grams), chunk.column("chunk")[0].as_py(), dtype=np.int64), "gram": grams})

    return asking


def _scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    grams = answers.column("gram").to_numpy().view(np.uint64)
    weights, left = (answers.column(name).to_numpy().astype(np.float64) for name in ("weight", "left"))
    known, contexts = ~np.isnan(weights), ~np.isnan(left)
    model = sharded(np.concatenate([grams[known], grams[contexts] ^ END]), np.concatenate([weights[known], left[contexts]]))
    found = pa.array(perplexities(chunk.column("bytes").to_pylist(), model), pa.float64())
    return chunk.select(["doc_id", "row", "lang"]).append_column("perplexity", found)


@contextmanager
def bucketed(model: DataFrame, scratch: Scratch) -> Iterator[DataFrame]:
    """The model in single precision, in buckets by `gram`: its weight as an n-gram, and what it leaves as a context.

    The table is in the session's catalog while the block lasts, its files in the scratch folder.
    """
    spark, name = scratch.spark, f"salesloom_quality_{uuid.uuid4().hex}"
    buckets = min(max(partitions(spark), -(-model.count() // BUCKET_ROWS)), MOST_BUCKETS)
    context = F.col("kind") < 0
    gram = F.when(context, F.col("key").bitwiseXOR(F.lit(int(END)))).otherwise(F.col("key"))
    weight = F.col("weight").cast("float")
    named = model.select(gram.alias("gram"), F.when(~context, weight).alias("weight"), F.when(context, weight).alias("left"))
    rows = named.repartition(buckets, "gram").groupBy("gram").agg(F.max("weight").alias("weight"), F.max("left").alias("left"))
    place = f"{scratch.folder}/model".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (gram BIGINT, weight FLOAT, `left` FLOAT) USING parquet OPTIONS (compression 'zstd') "
        f"CLUSTERED BY (gram) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    try:
        with shuffles_removed(spark):
            rows.write.insertInto(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.remove("model")


def score(rows: DataFrame, model: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, row, lang and perplexity of all rows, which have their texts in column `bytes`, under a bucketed model."""
    spark = scratch.spark
    with shuffles_removed(spark):
        content = spark.sparkContext.broadcast(bitmap_over(model.select("gram"), model.count()))
    size = rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    rounds = min(ROUNDS, chunks)
    for turn in range(rounds):
        with shuffles_removed(spark):
            chunk = dealt.where(F.pmod("chunk", F.lit(rounds)) == turn).repartition("chunk").groupBy("chunk")
            # A bucket is of bounded size, so that tasks can hold it in a hash table.
            known = chunk.applyInArrow(_asking(content), ASKED).join(model.hint("shuffle_hash"), "gram").repartition("chunk")
            found = scratch.table(chunk.cogroup(known.groupBy("chunk")).applyInArrow(_scored, SCORED), "scored", "append")
    content.destroy()
    return found


def _draw(doc_id: str | Column = "doc_id") -> Column:
    return F.xxhash64(doc_id, F.lit("quality"))


def _sampled(texts: DataFrame, scratch: Scratch, docs: int | None, words: int | None) -> DataFrame:
    """Whole texts by a hash of their ids, `docs` of them and as many as hold `words` (the last one may pass it)."""
    n_words = F.regexp_count(F.col("bytes").cast("string"), F.lit(WORD)).cast("long")
    if docs is not None:
        ids = texts.select("doc_id").distinct().orderBy(_draw(), "doc_id").limit(docs)
        texts = texts.join(scratch.table(ids, "chosen"), "doc_id", "left_semi")
    texts = scratch.table(texts.select("doc_id", "row", "bytes", n_words.alias("n_words")), "sample")
    if words is None:
        return texts
    before = Window.orderBy(_draw(), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    taken = texts.select("row", F.coalesce(F.sum("n_words").over(before), F.lit(0)).alias("before")).where(F.col("before") < words)
    return texts.join(taken, "row")


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """(of, most) of values (of, perplexity): the least value that so many are not above, exactly.

    A sketch tells its surroundings, in which the different values are ranked by their counts.
    """
    around = [min(max(quantile + 2 * side / ACCURACY, 0.0), 1.0) for side in (-1, 1)]
    groups = values.groupBy("of").agg(F.count("*").alias("n"), F.percentile_approx("perplexity", around, ACCURACY).alias("around"))
    groups = groups.select(F.col("of").alias("group"), F.greatest(F.ceil(F.lit(quantile) * F.col("n")), F.lit(1)).alias("rank"), "around")
    near = values.join(F.broadcast(groups), F.col("of").eqNullSafe(F.col("group"))).where(F.expr("perplexity <= around[1]"))
    # All values below the surroundings count as one.
    near = near.groupBy("of", "rank", F.expr("if(perplexity < around[0], null, perplexity)").alias("perplexity")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("of").orderBy(F.col("perplexity").asc_nulls_first()))
    return near.withColumn("upto", upto).where("upto >= rank").groupBy("of").agg(F.min("perplexity").alias("most"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    train_docs: int | None = None,
    train_words: int | None = None,
    quantile: float = QUANTILE,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """row, doc_id, lang, perplexity, most (the language's threshold) and kept, of every row.

    `row` is the row's place in the table. The model takes all trusted documents that are not
    held out, unless the caller bounds them or their words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    rows = numbered(docs.select("doc_id", "lang", text_bytes().alias("bytes")))

    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    trusted = labels.groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good and doc_id is not null")
    trusted = scratch.table(trusted.select("doc_id", (F.pmod(_draw(), F.lit(HELD_OUT)) == 0).alias("held_out")), "trusted")
    texts = rows.join(trusted.where("not held_out"), "doc_id", "left_semi")
    if train_docs is not None or train_words is not None:
        texts = _sampled(texts, scratch, train_docs, train_words)

    with bucketed(train(texts, scratch), scratch) as model:
        scratch.remove("counts-1", "counts-2", "counts-3", "words")
        scored = score(rows, model, scratch, chunk_bytes)
    unseen = scored.join(trusted.where("held_out"), "doc_id", "left_semi").where("perplexity is not null")
    by_language = quantiles(unseen.select(F.col("lang").alias("of"), "perplexity"), quantile).withColumnRenamed("most", "own")
    overall = quantiles(unseen.select(F.lit("").alias("of"), "perplexity"), quantile).first()
    most = F.coalesce("own", F.lit(overall and overall["most"]).cast("double"))
    return (
        scored.join(F.broadcast(by_language), F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("most", most)
        .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(True)))
        .select("row", "doc_id", "lang", "perplexity", "most", "kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected; `docs` is read several times, in the same order."""
    row = free_name(docs, "row")
    kept = judge(docs, labels).where("kept").select(F.col("row").alias(row))
    return numbered(docs, row).join(kept, row, "left_semi").drop(row)
