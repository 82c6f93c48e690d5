"""Which hashes come often, told without sending what they stand for.

Tasks sketch the hashes that they meet: sorted and distinct, six bytes each with a count,
in a row for each range of hashes. The sketches of a range meet and add up; what comes
often enough is a set bit in a bitmap of bounded size that goes to the tasks of a later
pass. A bit set by chance, or hashes that collide, let something pass in vain: whoever
asks has to decide by other means about what passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch

#: Bits of the bitmap for each frequent hash, within a least and a most (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
#: Of a hash, the bits that count; a range of hashes for so many bytes of text, and the least number of ranges.
HASH_BITS = 48
RANGE_BYTES, LEAST_RANGES = 1 << 24, 1 << 8

#: Bits of a page, and hashes of a task that are dealt to pages at once.
PAGE_BITS, PLACED_HASHES = 1 << 16, 1 << 22

SKETCH = "range long, hashes binary, counts binary"


def ranges_for(n_bytes: int) -> int:
    """A power of two: the ranges for so many bytes of text."""
    ranges = LEAST_RANGES
    while ranges < n_bytes / RANGE_BYTES:
        ranges *= 2
    return ranges


def shift_of(ranges: int) -> np.uint64:
    return np.uint64(HASH_BITS - (ranges.bit_length() - 1))


class Bitmap:
    """The hashes of what can be frequent, modulo the number of bits."""

    def __init__(self, content: bytes):
        self.raw, self.content = content, np.frombuffer(content, dtype=np.uint8)
        self.mask = np.uint64(8 * len(content) - 1)
        self.last = 8 * len(content) - 1

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.content[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def has(self, hashed: int) -> bool:
        """Whether it holds one hash, without an array of one."""
        at = hashed & self.last
        return self.raw[at >> 3] >> (at & 7) & 1 > 0


def sketched(hashes: np.ndarray, counts: np.ndarray, ranges: int, least: int) -> pa.RecordBatch:
    """Hashes, sorted and distinct, by range: the rest of each in five bytes, its count, at most `least`, in one."""
    shift = shift_of(ranges)
    parts = hashes >> shift
    rests = np.ascontiguousarray(hashes & ((np.uint64(1) << shift) - np.uint64(1))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    kept = np.minimum(counts, least).astype(np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
    at = list(zip(edges, edges[1:]))
    columns = [
        pa.array(parts[[lo for lo, _ in at]].astype(np.int64)),
        pa.array([rests[lo:hi].tobytes() for lo, hi in at], pa.binary()),
        pa.array([kept[lo:hi].tobytes() for lo, hi in at], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["range", "hashes", "counts"])


def _frequent(ranges: int, least: int):
    shift = shift_of(ranges)

    def frequent(sketches: pa.Table) -> pa.Table:
        rests = np.frombuffer(b"".join(sketches.column("hashes").to_pylist()), dtype=np.uint8).reshape(-1, 5)
        hashes = np.zeros((len(rests), 8), dtype=np.uint8)
        hashes[:, :5] = rests
        hashes, places = np.unique(hashes.view("<u8").reshape(-1), return_inverse=True)
        counts = np.frombuffer(b"".join(sketches.column("counts").to_pylist()), dtype=np.uint8)
        found = hashes[np.bincount(places, counts, len(hashes)) >= least].astype(np.uint64)
        return pa.table({"hash": (found | np.uint64(sketches.column("range")[0].as_py()) << shift).astype(np.int64)})

    return frequent


def bitmap_of(sketches: DataFrame, ranges: int, least: int, scratch: Scratch, name: str) -> bytes:
    """A bit for each hash whose counts add up to `least`; at most MOST_BITS come to the driver."""
    hashes = scratch.table(sketches.groupBy("range").applyInArrow(_frequent(ranges, least), "hash long"), name)
    bits, wanted = LEAST_BITS, BITS_EACH * hashes.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = hashes.select((F.col("hash").bitwiseAND(bits - 1) + 1).alias("at"))  # Spark's bitmaps number their bits from 1
    pages = at.groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    content = bytearray(bits // 8)
    for page in pages.collect():
        content[(page.page - 1) * len(page.bits) : page.page * len(page.bits)] = page.bits
    return bytes(content)


def _placed(bits: int):
    """The set bits of each page, two bytes each."""

    def pages(hashes: list[np.ndarray]) -> pa.RecordBatch:
        at = np.sort((np.concatenate(hashes) & np.int64(bits - 1)).astype(np.uint32))
        number = at // np.uint32(PAGE_BITS)
        edges = np.flatnonzero(np.diff(number, prepend=-1, append=1 << 32))
        within = (at % np.uint32(PAGE_BITS)).astype("<u2")
        places = pa.array([within[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(number[edges[:-1]].astype(np.int32)), places], names=["page", "places"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= PLACED_HASHES:
                yield pages(held)
                held = []
        if held:
            yield pages(held)

    return placed


def _page(pages: pa.Table) -> pa.Table:
    bits = np.zeros(PAGE_BITS, dtype=np.uint8)
    for places in pages.column("places").to_pylist():
        bits[np.frombuffer(places, dtype="<u2")] = 1
    return pa.table({"page": pages.column("page")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bitmap_over(hashes: DataFrame, n: int) -> bytes:
    """A bit for each of n hashes, the one column, however many they are; at most MOST_BITS come to the driver."""
    bits = LEAST_BITS
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    pages = hashes.mapInArrow(_placed(bits), "page int, places binary").groupBy("page").applyInArrow(_page, "page int, bits binary")
    content = bytearray(bits // 8)
    for page in pages.collect():
        content[page.page * PAGE_BITS // 8 : (page.page + 1) * PAGE_BITS // 8] = page.bits
    return bytes(content)
