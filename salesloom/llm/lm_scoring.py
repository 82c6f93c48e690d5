"""LM scoring: stupid backoff over the n-gram counts of the whole corpus.

The score of a word after its predecessors is the count of the longest n-gram over that
of its context; each time the n-gram is new, the context loses a word and the score a
factor. A document is scored by what the *other* documents hold: its own n-grams are
taken off the counts, else every n-gram of the corpus would be known.

Documents are dealt into chunks of bounded size. A chunk explodes its n-grams into rows of
a hash and a count, one for each distinct n-gram: a map-side combine, so that an n-gram
in every document weighs one row a chunk. These rows, partitioned by hash, are summed to
a count table of the n-grams that several chunks hold, and joined to it in the same
partitioning. What other chunks hold goes back to the chunk, which adds its own count,
takes each document's own off and sums the logarithms. Words and pairs go first; a longer n-gram
is asked for only if other chunks hold both of its parts, as else they can't hold it. All
counts stay exact.

Words are runs of other bytes than white space, A-Z lower-cased. A word that no other
document has counts as one seen once. Null texts and texts without words have no words
and score 0. Repeated rows are documents of their own. Other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import WORD, mix, numbered, text_bytes, windows_of, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Bytes of text behind one chunk.
CHUNK_BYTES = 8 << 20

ASKED = "chunk long not null, gram long not null, n int not null"
SCORED = "doc_id long, n_words long, log_score double"


class Words:
    """The words of a chunk's texts, one text after the other."""

    def __init__(self, texts: list[bytes]):
        split = [text.lower().split() for text in texts]
        self.n_words = np.array([len(words) for words in split], dtype=np.int64)
        self.hashes = word_hashes([word for words in split for word in words])
        self.document = np.repeat(np.arange(len(texts)), self.n_words)
        starts = np.cumsum(self.n_words) - self.n_words
        #: How many words of its text are before each word.
        self.before = np.arange(len(self.hashes)) - np.repeat(starts, self.n_words)

    def ends(self, length: int) -> np.ndarray:
        """The words at which an n-gram of this length ends."""
        return np.flatnonzero(self.before >= length - 1)

    def grams(self, length: int) -> np.ndarray:
        """The hashes of the n-grams that end there."""
        ends = self.ends(length)
        if not len(ends):
            return np.empty(0, dtype=np.int64)
        return mix(windows_of(self.hashes, length) + np.uint64(length))[ends - length + 1].view(np.int64)


class Others:
    """What the count table answered: how often other chunks hold an n-gram."""

    def __init__(self, answers: pa.Table):
        grams = answers.column("gram").to_numpy()
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], answers.column("others").to_numpy()[order]

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.counts[at], 0)


def _rows(chunk: pa.Table, grams: np.ndarray) -> pa.Table:
    distinct, counts = np.unique(grams, return_counts=True)
    numbers = np.full(len(distinct), chunk.column("chunk")[0].as_py(), dtype=np.int64)
    return pa.table({"chunk": numbers, "gram": distinct.astype(np.int64), "n": counts.astype(np.int32)})


def _first(longest: int):
    def first(chunk: pa.Table) -> pa.Table:
        words = Words(chunk.column("bytes").to_pylist())
        return _rows(chunk, np.concatenate([words.grams(length) for length in range(1, longest + 1)]))

    return first


def _longer(length: int):
    def longer(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        words, others = Words(chunk.column("bytes").to_pylist()), Others(answers)
        shared = np.zeros(len(words.hashes) + 1, dtype=bool)  # the last one for the word before the first
        shared[words.ends(length - 1)] = others.of(words.grams(length - 1)) > 0
        ends = words.ends(length)
        return _rows(chunk, words.grams(length)[shared[ends] & shared[ends - 1]])

    return longer


def _answers(asked: DataFrame) -> DataFrame:
    """How often others hold the n-grams that a chunk asked for and does not hold alone.

    Both sides of the join read all columns of one shuffle, so that Spark writes it once.
    """
    asked = asked.repartition("gram")
    counts = asked.groupBy("gram").agg(F.sum("n").alias("total"), F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    shared = counts.where("least < most").select("gram", "total")
    return asked.join(shared, "gram").select("chunk", "gram", F.expr("total - n").alias("others"))


def scores_of(words: Words, others: Others, all_words: int, order: int, backoff: float) -> np.ndarray:
    """Summed log scores of a chunk's documents."""
    log = np.zeros(len(words.n_words))
    other_words = all_words - words.n_words[words.document]
    shorter = score = None
    for length in range(1, order + 1):
        ends, (distinct, place, counts) = words.ends(length), np.unique(
            words.grams(length), return_inverse=True, return_counts=True
        )
        # How often a document has an n-gram itself.
        pairs = words.document[ends] * np.int64(len(distinct) + 1) + place
        _, pair, own = np.unique(pairs, return_inverse=True, return_counts=True)
        other = np.zeros(len(words.hashes))
        other[ends] = (others.of(distinct) + counts)[place] - own[pair]
        if length == 1:
            score = np.maximum(other, 1.0) / np.maximum(other_words, 1.0)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = other[ends] / shorter[ends - 1]
            score[ends] = np.where(other[ends] > 0, direct, backoff * score[ends])
        shorter = other
    np.add.at(log, words.document, np.log(score))
    return log


def _scored(order: int, backoff: float, all_words: int):
    def scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(chunk.column("bytes").to_pylist())
        log = scores_of(words, Others(answers), all_words, order, backoff)
        return pa.Table.from_arrays(
            [chunk.column("doc_id").combine_chunks(), pa.array(words.n_words), pa.array(log)],
            names=["doc_id", "n_words", "log_score"],
        )

    return scored


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words and log_score of every row."""
    texts = docs.select("doc_id", text_bytes().alias("bytes"))
    size, all_words = docs.agg(
        F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)).cast("bigint"))
    ).first()
    chunks = max(1, -(-(size or 0) // chunk_bytes))
    # Row numbers deal out any documents evenly, whatever ids they share.
    number = F.pmod(F.xxhash64("row"), F.lit(chunks))
    dealt = numbered(texts).withColumn("chunk", number).drop("row").repartition("chunk")
    chunk = dealt.groupBy("chunk")
    answers = _answers(chunk.applyInArrow(_first(min(order, 2)), ASKED)).repartition("chunk")
    for length in range(3, order + 1):
        asked = chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_longer(length), ASKED)
        answers = answers.unionByName(_answers(asked).repartition("chunk"))
    return chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_scored(order, backoff, all_words or 0), SCORED)
