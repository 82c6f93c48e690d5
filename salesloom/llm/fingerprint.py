"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

A text's sketch holds the hash of every five-word shingle that lies below a fixed
fraction of the hash range, so its size follows the text's. Two sketches merge into the
sketch of both texts by a union, and their overlap estimates likeness and containment,
however unequal the texts are. If no hash lies below, the sketch is the least one, so
that only a text without words has an empty one; a union drops it for a lower hash. Fewer than five words make one shingle.

`edited` pairs each document with the next one in descending order of doc_id. The
documents are dealt into ranges of ids, each with a guest row: the first document of
the following range. One shuffle brings neighbours together; no window spans the table.

Null texts count as empty. Null ids come last, and rows of one id are ordered by text.
Two empty sketches have likeness 1, an empty and another one 0. Other columns of the
documents take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import BREAKS, partitions

SHINGLE_WORDS = 5
#: One hash in so many is kept.
SCALE = 8
#: Text of one range.
RANGE_BYTES = 32 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once for all its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of `words` words, in the order of the text; empty without a word."""
    bare = F.btrim(text, F.lit(BREAKS))
    hashes = F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda word: F.xxhash64(word))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(words))))

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(_let(hashes, runs))


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below the threshold; if there are none, the least hash."""
    return _let(shingle_hashes(text, words), lambda h: _kept(h, scale))


def _kept(hashes: Column, scale: int) -> Column:
    threshold = -(2**63) + 2**64 // scale

    def least_or(low: Column) -> Column:
        return F.when((F.size(low) > 0) | (F.size(hashes) == 0), low).otherwise(F.array(F.array_min(hashes)))

    return _let(F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < F.lit(threshold)))), least_or)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of both texts' shingles together."""
    return _let(F.array_union(a, b), lambda both: _kept(both, scale))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty sketch."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.hex(x)), ",")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text (empty for null) and sketch."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("sketch", sketch(F.col("text")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text and next_sketch: each document with the one after it.

    After the last one comes the first. There are as many ranges as the texts' bytes ask
    for. Their bounds are estimated quantiles of the ids; they only decide where ranges
    end, not the order.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    quantiles = docs.select("doc_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))
    bounds = F.array(*(F.lit(min(int(q), 2**63 - 1)) for q in sorted(set(quantiles)))).cast("array<bigint>")
    # Ranges count downwards with the ids: 0 has the largest ids, the last one the nulls.
    block = F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(
        F.size(F.filter(bounds, lambda bound: bound >= F.col("doc_id")))
    )
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("block", block)

    # One row a range and n ranges at most, so these windows and the broadcast are small.
    order = Window.orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = placed.groupBy("block").agg(F.max("doc_id").alias("head_id")).select(
        F.coalesce(F.lag("block").over(order), F.last("block").over(whole)).alias("host"), "block", "head_id"
    )
    is_head = (placed["block"] == heads["block"]) & placed["doc_id"].eqNullSafe(heads["head_id"])
    guests = placed.join(F.broadcast(heads), is_head).groupBy("host").agg(F.min("text").alias("text"))

    rows = placed.withColumn("guest", F.lit(False)).unionByName(
        guests.select(
            F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("host").alias("block"), F.lit(True).alias("guest")
        )
    )
    in_block = Window.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return (
        rows.repartition(n, "block")
        .withColumn("sketch", sketch(F.col("text")))
        .withColumns({f"next_{c}": F.lead(c).over(in_block) for c in ("text", "sketch")})
        .where(~F.col("guest"))
        .drop("guest", "block")
    )


def edited(docs: DataFrame) -> DataFrame:
    """`with_next` with n_chars and edited_text.

    The edited text has its last half, rounded down, replaced by as many characters from
    the start of the next text, or by all of that if it is shorter.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return with_next(docs).withColumn("n_chars", F.length("text").cast("bigint")).withColumn(
        "edited_text",
        F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.substring("next_text", F.lit(1), half),
        ),
    )
