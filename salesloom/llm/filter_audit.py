"""Filter interaction audit: what each order of five filters removes, and on whose account.

One pass over the UTF-8 bytes counts what the filters ask for. A byte's class and the
machine's state (between words, or in one) give by table the next state and what to count:
a word begins, a word ends, a code point, a capital, a symbol. The next state depends on
the byte's class alone, so the states of a whole window are looked up at once. The word
spans that come out go into a hash table per document, a set of bytes: equal hashes count
as one word only if the bytes are equal.

    A  under 200 words                       D  holds any of #$%&*|
    B  distinct words under half the words   E  the text of a smaller doc_id, anywhere in
    C  capitals over 3 % of the code points     the table, whether removed or not

Texts are compared for E by 128-bit hashes. A document then is the set of filters that it
fails, so all 120 orders are read from the counts of at most 32 sets a part.

Parts are the languages, null as the empty string. Null texts are empty ones; those of
several documents are equal. Rows that share a doc_id do not repeat each other; a null
doc_id is neither smaller nor greater than another. Repeated rows count each, repeated
labels of a document once (any of them may make it good or toxic). Columns other than
doc_id, text and lang take no part. Windows of a long text end at blanks, so memory holds
a window and the text's distinct words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, text_bytes

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
#: Bytes that are looked up at once.
WINDOW = 1 << 22

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"
BLANK, LETTER, CAPITAL, SYMBOL, FOLLOWING = range(5)
BETWEEN, INSIDE = range(2)
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16

CLASS_OF = np.full(256, LETTER, dtype=np.uint8)
CLASS_OF[list(BLANKS)] = BLANK
CLASS_OF[list(SYMBOLS)] = SYMBOL
CLASS_OF[ord("A") : ord("Z") + 1] = CAPITAL
CLASS_OF[0x80:0xC0] = FOLLOWING

NEXT_STATE = np.array([BETWEEN, INSIDE, INSIDE, INSIDE, INSIDE], dtype=np.uint8)
COUNTED = np.array([POINT, POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, 0], dtype=np.uint8)
#: What to emit in a state (row) on a class (column).
EMITTED = np.stack([COUNTED, COUNTED])
EMITTED[BETWEEN, LETTER:] |= BEGINS
EMITTED[INSIDE, BLANK] |= ENDS

MEASURES = ("words", "distinct_words", "code_points", "capitals", "symbols")


def transduce(window: bytes) -> np.ndarray:
    """What the machine emits at each byte of a window, from the state between words."""
    classes = CLASS_OF[np.frombuffer(window, dtype=np.uint8)]
    states = np.empty_like(classes)
    states[:1] = BETWEEN
    states[1:] = NEXT_STATE[classes[:-1]]
    return EMITTED.reshape(-1)[states * np.uint8(EMITTED.shape[1]) + classes]


def windows(text: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text, cut after blanks, of about `size` bytes but for longer words."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(blank, at, at + size) for blank in (BLANKS[k : k + 1] for k in range(len(BLANKS))))
        if cut < 0:
            found = [f for f in (text.find(BLANKS[k : k + 1], at + size) for k in range(len(BLANKS))) if f >= 0]
            cut = min(found, default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def _measure_window(texts: list[bytes], tables: list[set]) -> np.ndarray:
    """Counts of texts laid side by side, a blank after each; their words go into the tables."""
    joined = b" ".join([*texts, b""])
    emitted = transduce(joined)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    counts = np.empty((len(texts), len(MEASURES)), dtype=np.int64)
    for column, flag in ((0, BEGINS), (2, POINT), (3, IS_CAPITAL), (4, IS_SYMBOL)):
        counts[:, column] = np.add.reduceat((emitted & flag) > 0, begins, dtype=np.int64)
    counts[:, 2] -= 1  # the blank after it
    spans = map(slice, np.flatnonzero(emitted & BEGINS).tolist(), np.flatnonzero(emitted & ENDS).tolist())
    words = map(joined.__getitem__, spans)
    for k, (table, n) in enumerate(zip(tables, counts[:, 0].tolist())):
        table.update(itertools.islice(words, n))
        counts[k, 1] = len(table)
    return counts


def measure_texts(texts: list[bytes], size: int = WINDOW) -> np.ndarray:
    """A row of the MEASURES for each text."""
    counts = np.zeros((len(texts), len(MEASURES)), dtype=np.int64)
    k = 0
    while k < len(texts):
        if len(texts[k]) > size:
            table: set[bytes] = set()
            for window in windows(texts[k], size):
                part = _measure_window([window], [table])[0]
                counts[k] += part
                counts[k, 1] = part[1]
            k += 1
            continue
        begin, held = k, 0
        while k < len(texts) and held + len(texts[k]) <= size:
            held += len(texts[k])
            k += 1
        counts[begin:k] = _measure_window(texts[begin:k], [set() for _ in range(begin, k)])
    return counts


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("data").to_pylist()
        counts = measure_texts(texts)
        columns = [batch.column("doc_id"), batch.column("part"), *(pa.array(counts[:, k]) for k in range(len(MEASURES)))]
        columns.append(pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", *MEASURES, "digest"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, part, the MEASURES, digest) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{name} long" for name in MEASURES)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_bytes().alias("data"))
    return rows.mapInArrow(_measured, f"doc_id {kind}, part string, {fields}, digest binary")


def failures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part, fails) of each document; bit k of `fails` stands for FILTERS[k]."""
    failed = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct_words") < DISTINCT_PERCENT * F.col("words"),
        100 * F.col("capitals") > CAPITAL_PERCENT * F.col("code_points"),
        F.col("symbols") > 0,
    ]
    alone = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    rows = scratch.table(measure(docs).select("doc_id", "part", "digest", alone.alias("alone")), "measured")
    # Written, so that rows of a frequent text meet their first id in a join that splits hot keys.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.table(firsts.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "firsts")
    again = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("alone") + again).alias("fails"))


def _steps() -> list[tuple[str, int, str, int, int]]:
    """(order, step, its filter, the filter's bit, the bits of the filters before) of all orders."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, letter, bit, before))
            before |= bit
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the module for the filters.

    The documents meet one join by text and one by doc_id, on narrow rows; their counts by
    part and set of failed filters are all that the orders are worked out from.
    """
    scratch = Scratch(docs.sparkSession, "filter_audit")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"),
    )
    known = scratch.table(known.where("good + toxic > 0"), "labels")
    judged = failures(docs, scratch).join(known, "doc_id", "left")
    kinds = judged.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    kinds = scratch.table(kinds, "kinds")
    scratch.remove("measured", "firsts", "labels")

    steps = ", ".join(f"struct('{order}', {step}, '{letter}', {bit}, {before})" for order, step, letter, bit, before in _steps())
    each = kinds.select("*", F.expr(f"inline(array({steps})) AS (filter_order, step, letter, bit, before)"))
    fails, bit, before = F.col("fails"), F.col("bit"), F.col("before")
    here, earlier = fails.bitwiseAND(bit) > 0, fails.bitwiseAND(before) > 0

    def total(condition, of="n"):
        return F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0).cast("long")))

    counted = each.groupBy("part", "filter_order", "step", "letter").agg(
        total(~here & ~earlier).alias("kept"),
        total(here & ~earlier).alias("removed"),
        total(here & earlier).alias("redundant"),
        total(fails == bit).alias("unique_fails"),
        total(here & ~earlier, "good").alias("good_lost"),
        total(here & ~earlier, "toxic").alias("toxic_lost"),
    )
    over_orders = Window.partitionBy("part", "letter")
    return counted.withColumn("shapley", F.sum("removed").over(over_orders)).drop("letter")
