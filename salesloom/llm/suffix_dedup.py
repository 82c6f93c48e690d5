"""Exact substring dedup: bucket-pointer refinement over sampled suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a
document of smaller doc_id, or before in the same text. Suffixes fall into buckets by
their first q bytes, q at least half of `LENGTH`. A bucket's identifier stands for what
its suffixes begin with; two identifiers, one at a suffix and one at a later offset of it,
make that of a finer bucket, which serves the next level in the same way:

    level 0   q bytes       their fingerprint
    level 1   a string      level 0 at its start and q bytes before its end
    level 2   a run         level 1 at the first and the last of some strings in a row

Only suffixes at anchors start at level 0: every string has one, the place of the least
identifier of level 0 in it. That depends on the string alone, so equal strings have it
at the same offset. The strings in a row that share an anchor are its run.

1. Buckets of level 0 with one suffix are settled. The tasks learn by a bitmap which ones
   may have more (see `sketches`); a bit set by chance costs work, not correctness.
2. The others are refined to level 2, runs. A run that a smaller document has too goes as
   a whole. Is it the only run of its bucket of level 0, there is nothing else to find.
3. Where a bucket holds several runs, their strings may be equal although the runs are
   not. These, near the ends of a match, are told apart at level 1, again but for those
   that a bitmap tells to be alone.

Levels 1 and 2 remove by 96 and 128 bits of two independent fingerprints. Per bucket only
the smallest doc_id is needed, a map-side aggregate, written before it meets the
suffixes, so that the join splits a hot bucket. What a text repeats within itself is found
on the spot.

Null texts count as empty; what is shorter than `LENGTH` stays. Rows that share a doc_id
do not remove each other's bytes; rows without one (or with the largest 64-bit one) come
last and do not either. A text is held in memory with some sixty times its size. Other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch, mix, numbered, text_bytes
from salesloom.llm.sketches import HASH_BITS, SKETCH, Bitmap, bitmap_of, ranges_for, sketched

LENGTH = 100
GRAM = 51
#: Identifiers that a task sorts at once for a sketch.
MOST_HASHES = 1 << 22
LAST_ID = 2**63 - 1

_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_STEP = np.uint64(0xBF58476D1CE4E5B9)


def _sketch_of(identifiers: np.ndarray) -> np.ndarray:
    return identifiers >> np.uint64(64 - HASH_BITS)


class Text:
    """Identifiers of a text's buckets; level 0 from prefix sums of polynomials modulo 2**64.

    There are two families, from different bases and letters.
    """

    powers = [np.ones(1, dtype=np.uint64) for _ in _BASES]
    inverses = [np.ones(1, dtype=np.uint64) for _ in _BASES]
    letters = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64)) for k in range(2)]

    def __init__(self, data: bytes, length: int, gram: int):
        if not gram <= length <= 2 * gram:
            raise ValueError("a string is as long as one to two q-grams")
        self.data, self.size, self.length, self.gram = data, len(data), length, gram
        self.sums: dict[int, np.ndarray] = {}
        sums = self._sums(0)
        self.grams = mix((sums[gram:] - sums[:-gram]) * Text.inverses[0][: self.size - gram + 1])

    def _sums(self, family: int) -> np.ndarray:
        if family not in self.sums:
            n = self.size
            if n >= len(Text.powers[family]):
                base = _BASES[family]
                Text.powers[family], Text.inverses[family] = (
                    np.cumprod(np.r_[np.uint64(1), np.full(2 * n, b, dtype=np.uint64)]) for b in (base, pow(base, -1, 2**64))
                )
            letters = Text.letters[family].take(np.frombuffer(self.data, dtype=np.uint8))
            letters *= Text.powers[family][:n]
            self.sums[family] = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(letters, out=self.sums[family][1:])
        return self.sums[family]

    def level0(self, at: np.ndarray, family: int = 0) -> np.ndarray:
        if family == 0:
            return self.grams[at]
        sums = self._sums(family)
        return mix((sums[at + self.gram] - sums[at]) * Text.inverses[family][at])

    def level1(self, at: np.ndarray, family: int = 0) -> np.ndarray:
        """Of the strings at some places."""
        return mix(self.level0(at, family) * _STEP + self.level0(at + (self.length - self.gram), family))

    def level2(self, first: np.ndarray, last: np.ndarray, family: int = 0) -> np.ndarray:
        """Of the runs from one string to another, which overlap."""
        return mix(self.level1(first, family) * _STEP + self.level1(last, family) + (last - first).astype(np.uint64))

    def anchors(self) -> np.ndarray:
        """For each start of a string the place of its anchor."""
        grams = self.grams
        least, reach, width = grams, 1, self.length - self.gram + 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[step:], least[:-step])
            reach += step
        # Starts of one and the same least hash in a row share its first place, up to there.
        begin = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        end = np.r_[begin[1:], len(least)]
        parts = []
        while len(begin):
            place = begin + np.argmin(grams[begin[:, None] + np.arange(width)], axis=1)
            until = np.minimum(end, place + 1)
            parts.append((begin, until, place))
            more = until < end
            begin, end = until[more], end[more]
        begin, until, place = map(np.concatenate, zip(*parts))
        order = np.argsort(begin, kind="stable")
        return np.repeat(place[order], (until - begin)[order])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last string of each run, and the place of its anchor."""
        at = self.anchors()
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        return first, np.r_[first[1:], len(at)] - 1, at[first]


def _taken(met: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    hashes, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *met]), return_counts=True)
    met.clear()
    return sketched(hashes, counts, ranges, 2)


def _gram_sketch(length: int, gram: int, ranges: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        for batch in batches:
            for data in batch.column("bytes").to_pylist():
                if len(data) >= length:
                    text = Text(data, length, gram)
                    met.append(_sketch_of(text.level0(text.runs()[2])))
            if sum(map(len, met)) > MOST_HASHES:
                yield _taken(met, ranges)
        yield _taken(met, ranges)

    return sketch


RUNS = "gram long, run_a long, run_b long, doc long, row long, twice int"


def _runs(length: int, gram: int, several: Broadcast):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(several.value)
        for batch in batches:
            of, columns, twice = [], ([], [], []), []
            for k, data in enumerate(batch.column("bytes").to_pylist()):
                if len(data) < length:
                    continue
                text = Text(data, length, gram)
                first, last, at = text.runs()
                own = text.level0(at)
                kept = np.flatnonzero(bits.holds(_sketch_of(own)))
                if not len(kept):
                    continue
                first, last, own = first[kept], last[kept], own[kept]
                _, place, count = np.unique(own, return_inverse=True, return_counts=True)
                found = np.c_[own, text.level2(first, last), text.level2(first, last, 1)]
                again = count[place] > 1
                if again.any():  # a run that comes again in the text is one row
                    once = np.sort(np.unique(found, axis=0, return_index=True)[1])
                    found, again = found[once], again[once]
                of.append(np.full(len(found), k))
                twice.append(again.astype(np.int32))
                for column, values in zip(columns, found.T):
                    column.append(values)
            if of:
                of = pa.array(np.concatenate(of))
                made = [pa.array(np.concatenate(c).view(np.int64)) for c in columns]
                ids = [batch.column(c).take(of) for c in ("doc", "row")]
                names = ["gram", "run_a", "run_b", "doc", "row", "twice"]
                yield pa.RecordBatch.from_arrays([*made, *ids, pa.array(np.concatenate(twice))], names=names)

    return runs


def _run_sketch(ranges: int):
    """Sketches of the buckets of level 0 by their runs: each bucket as often as it has runs, two at most."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        for batch in batches:
            met.append(_sketch_of(batch.column("gram").to_numpy().view(np.uint64)))
            if sum(map(len, met)) > MOST_HASHES:
                yield _taken(met, ranges)
        yield _taken(met, ranges)

    return sketch


def _in(values: np.ndarray, listed: list[int] | None) -> np.ndarray:
    if not listed:
        return np.zeros(len(values), dtype=bool)
    return np.isin(values.view(np.int64), np.array(listed, dtype=np.int64))


def _starts_of(first: np.ndarray, last: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The strings of the chosen runs."""
    return np.flatnonzero(np.repeat(chosen, last - first + 1))


STRINGS = "row long, doc long, strings binary"
#: Bytes of a string's identifier: 64 bits of one family and 32 of the other.
STRING_BYTES = 12


def _strings(length: int, gram: int):
    """The strings that are still unclear, of each text that has any."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, runs, grams in zip(*(batch.column(c).to_pylist() for c in ("bytes", "runs", "grams"))):
                text = Text(data, length, gram)
                first, last, at = text.runs()
                starts = _starts_of(first, last, _in(text.level0(at), grams) & ~_in(text.level2(first, last), runs))
                told = np.zeros((len(starts), STRING_BYTES), dtype=np.uint8)
                told[:, :8] = text.level1(starts).view(np.uint8).reshape(-1, 8)
                told[:, 8:] = text.level1(starts, 1).view(np.uint8).reshape(-1, 8)[:, :4]
                once = np.unique(text.level1(starts), return_index=True)[1]
                found.append(told[once].tobytes())
            columns = [batch.column("row"), batch.column("doc"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "strings"])

    return strings


def _identifiers(strings: bytes) -> tuple[np.ndarray, np.ndarray]:
    told = np.frombuffer(strings, dtype=np.uint8).reshape(-1, STRING_BYTES)
    return tuple(np.ascontiguousarray(part).view(kind).reshape(-1) for part, kind in ((told[:, :8], np.uint64), (told[:, 8:], np.int32)))


def _string_sketch(ranges: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = []
        for batch in batches:
            for strings in batch.column("strings").to_pylist():
                met.append(_sketch_of(_identifiers(strings)[0]))
                if sum(map(len, met)) > MOST_HASHES:
                    yield _taken(met, ranges)
        yield _taken(met, ranges)

    return sketch


def _met_again(several: Broadcast):
    """The strings that the bitmap has, one row each."""

    def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(several.value)
        for batch in batches:
            of, string, check = [], [], []
            for k, strings in enumerate(batch.column("strings").to_pylist()):
                a, b = _identifiers(strings)
                kept = bits.holds(_sketch_of(a))
                of.append(np.full(int(kept.sum()), k))
                string.append(a[kept])
                check.append(b[kept])
            if of:
                of = pa.array(np.concatenate(of))
                made = [pa.array(np.concatenate(string).view(np.int64)), pa.array(np.concatenate(check))]
                yield pa.RecordBatch.from_arrays([*made, *(batch.column(c).take(of) for c in ("doc", "row"))], names=["string", "check", "doc", "row"])

    return met_again


def covered_starts(
    data: bytes, runs: list[int] | None, strings: list[int] | None, length: int = LENGTH, gram: int = GRAM
) -> np.ndarray:
    """Whether the string at each start also starts earlier, here or by the given lists."""
    if len(data) < length:
        return np.zeros(0, dtype=bool)
    text = Text(data, length, gram)
    first, last, at = text.runs()
    covered = np.repeat(_in(text.level2(first, last), runs), last - first + 1)
    if strings:
        left = np.flatnonzero(~covered)
        covered[left[_in(text.level1(left), strings)]] = True
    # A text can only repeat a string where it has the string's q-gram at two anchors.
    own = text.level0(at)
    _, place, count = np.unique(own, return_inverse=True, return_counts=True)
    again = count[place] > 1
    if again.any():
        starts = _starts_of(first, last, again)
        once = np.unique(text.level1(starts), return_index=True)[1]
        later = np.ones(len(starts), dtype=bool)
        later[once] = False
        covered[starts[later]] = True
    return covered


def kept_bytes(data: bytes, covered: np.ndarray, length: int = LENGTH) -> tuple[bytes, int]:
    """What stays of a text, and the number of runs removed."""
    if not covered.any():
        return data, 0
    # +1 where a covered string starts, -1 behind its end: what adds up to more than 0 goes.
    ends = np.zeros(len(data) + 1, dtype=np.int64)
    ends[: len(covered)] += covered
    ends[length : length + len(covered)] -= covered
    gone = np.cumsum(ends[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), runs


def _removed(length: int, gram: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
    )

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, stay = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bytes", "runs", "strings"))
            for data, runs, strings in zip(*columns):
                kept, spans = data, 0
                if runs is not None:  # else no q-gram of it comes again anywhere
                    kept, spans = kept_bytes(data, covered_starts(data, runs, strings, length, gram), length)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept))
                n_spans.append(spans)
                stay.append(kept)
            numbers = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(stay, pa.binary())], schema=schema)

    return removed


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`, the bytes that stay, of every row.

    `docs` is read four times and must give the same rows in the same order, as a
    stored table does.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    rows = numbered(docs.select("doc_id", text_bytes().alias("bytes")))
    placed = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    texts = rows.select("bytes")
    ranges = ranges_for(texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0)

    def tell(sketches: DataFrame, name: str) -> Broadcast:
        return spark.sparkContext.broadcast(bitmap_of(sketches, ranges, 2, scratch, name))

    open_grams = tell(texts.mapInArrow(_gram_sketch(length, gram, ranges), SKETCH), "grams")
    runs = scratch.table(placed.select("bytes", "doc", "row").mapInArrow(_runs(length, gram, open_grams), RUNS), "runs")
    firsts = runs.groupBy("gram", "run_a", "run_b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    firsts = scratch.table(firsts, "firsts")
    several = tell(firsts.select("gram").mapInArrow(_run_sketch(ranges), SKETCH), "several")

    earlier = firsts.where("first < last").select("run_a", "run_b", "first")
    settled = runs.join(earlier, ["run_a", "run_b"], "left")
    nothing = F.lit(None).cast("long")
    gone = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    hints = settled.select(
        "row", F.when(gone, F.col("run_a")).alias("run"), F.when(gone, nothing).otherwise(F.col("gram")).alias("gram"), "twice"
    )
    hints = hints.mapInArrow(_unclear(several), "row long, run long, gram long").groupBy("row")
    hints = scratch.table(hints.agg(F.collect_set("run").alias("runs"), F.collect_set("gram").alias("grams")), "hints")
    scratch.remove("runs", "firsts", "grams", "several")

    unsettled = placed.join(hints.where(F.size("grams") > 0), "row").select("row", "doc", "bytes", "runs", "grams")
    strings = scratch.table(unsettled.mapInArrow(_strings(length, gram), STRINGS), "strings")
    again = tell(strings.select("strings").mapInArrow(_string_sketch(ranges), SKETCH), "again")
    met = scratch.table(strings.mapInArrow(_met_again(again), "string long, check int, doc long, row long"), "met")
    scratch.remove("strings", "again")
    firsts = met.groupBy("string", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    firsts = scratch.table(firsts.drop("last"), "first-strings")
    found = met.join(firsts, ["string", "check"]).where("doc > first").groupBy("row").agg(F.collect_set("string").alias("strings"))
    hints = scratch.table(hints.drop("grams").join(found, "row", "left"), "all-hints")
    scratch.remove("met", "first-strings", "hints")

    return (
        rows.join(hints, "row", "left")
        .select("doc_id", "bytes", "runs", "strings")
        .mapInArrow(_removed(length, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def _unclear(several: Broadcast):
    """What a row's text needs to know: runs that go, grams of unclear runs; nothing but the row for repeats of its own."""

    def unclear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(several.value)
        for batch in batches:
            row, run, gram, twice = (batch.column(c) for c in ("row", "run", "gram", "twice"))
            open_gram = np.zeros(len(batch), dtype=bool)
            known = gram.is_valid().to_numpy(zero_copy_only=False)
            values = gram.fill_null(0).to_numpy().view(np.uint64)
            open_gram[known] = bits.holds(_sketch_of(values[known]))
            kept = ~known | open_gram | (twice.to_numpy() > 0)
            gram = pa.array(values.view(np.int64), mask=~open_gram)
            columns = [c.filter(pa.array(kept)) for c in (row, run, gram)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "run", "gram"])

    return unclear
