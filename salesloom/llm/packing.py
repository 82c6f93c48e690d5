"""Best-fit packing of token sequences, certified by lower bounds.

Documents become token ids, longer ones are cut, and pieces shorter than a sequence are
dealt into partitions. Each partition is packed by best-fit decreasing, and dual-feasible
functions give a number of sequences that no packing of it can go below. A partition
that meets its bound is done. The others keep their full sequences, exchange the
documents of the rest among each other, and are packed again, as long as that saves
sequences, `ROUNDS` times at most. What a partition uses above its bound when that ends
is its gap; `gaps` sums them up.

Null texts count as empty: one end token. Rows that share a doc_id are packed each for
itself. Other columns of the documents take no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import Scratch

CAPACITY = 1024
END_ID = 2
#: Pieces of one partition; each round of exchange doubles them.
PARTITION_PIECES = 20_000
#: Rounds of exchange at most; each ends earlier without a gap or a gain.
ROUNDS = 3
#: The pre-tokens of byte-level BPE; a fixed pattern.
_PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer runs of white space than this make the pattern of pre-tokens recurse too deep.
_LONG_BLANK = re.compile(r"\s{1000}")
# Letters and digits that every version of Unicode in use agrees on.
_OTHER_LETTERS = re.compile("[^\x00-\u052f\u2000-\u206f]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes for the characters
    from 256 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + k): byte for k, byte in enumerate(others)}


class Encoder:
    """Ids of texts by the vocabulary of a tokenizers file, without special tokens added.

    The same merges run in a faster encoder, five times as fast on prose. Texts for which
    it could differ, with special tokens or letters of newer scripts, and those that it
    can't take, with long runs of white space, go through `tokenizers` itself; a test
    holds both against each other.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.specials = [token.content for token in self.exact.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {
            bytes(letters[c] for c in token): number
            for token, number in self.exact.get_vocab(with_added_tokens=False).items()
            if token not in self.specials
        }
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        other = not text.isascii() and _OTHER_LETTERS.search(text)
        if other or any(token in text for token in self.specials) or _LONG_BLANK.search(text):
            return self._exact(text)
        try:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        except BaseException as error:  # what the encoder panics with is no Exception
            if isinstance(error, KeyboardInterrupt | SystemExit | GeneratorExit):
                raise
            return self._exact(text)

    def _exact(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("number", pa.int64()),
    ]
)


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    starts = range(n_ids % capacity or min(n_ids, capacity), n_ids + 1, capacity)
    return [(max(0, end - capacity), end - max(0, end - capacity)) for end in starts]


def _pieces_of(tokenizer_path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            columns: list[list] = [[] for _ in PIECES]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                encoded = encode(text) + end
                for piece, (start, length) in enumerate(cut(len(encoded) // 4, capacity)):
                    crc = zlib.crc32(encoded[4 * start : 4 * (start + length)])
                    for column, value in zip(columns, (doc_id, piece, start, length, crc, number)):
                        column.append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number of each piece's own."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"
    return texts.mapInArrow(_pieces_of(tokenizer_path, capacity), schema)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that no packing can go below, by dual-feasible functions.

    First the functions that, for a threshold, count lengths over capacity - threshold as
    whole sequences and drop those under it. Then on top of each the ones that round a
    length to multiples of 1 / k, up where k + 1 of them would not fit.
    """
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size, threshold = np.arange(capacity + 1, dtype=np.int64), np.arange(capacity // 2 + 1, dtype=np.int64)[:, None]
    raised = np.where(size > capacity - threshold, capacity, np.where(size < threshold, 0, size))
    best = -(-int((raised @ count).max()) // capacity)
    for k in range(1, 13):
        share = (k + 1) * raised
        rounded = np.where(share % capacity == 0, raised * k, share // capacity * capacity)
        best = max(best, -(-int((rounded @ count).max()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken from long to short."""
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a sequence has room r
    opened = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, at, opened = capacity, opened, opened + 1
        sequence[k], offset[k] = at, capacity - room
        room -= length
        if room:
            with_room[room].append(at)
            rooms |= 1 << room
    return sequence, offset


PACKED = "number long, length long, part long, sequence long, offset long, filled long, gap long"


def _pack(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values("number").reset_index(drop=True)
    lengths = rows["length"].to_numpy(dtype=np.int64)
    sequence, offset = best_fit_decreasing(lengths, capacity)
    used = int(sequence.max()) + 1
    filled = np.bincount(sequence, weights=lengths).astype(np.int64)
    return rows.assign(
        sequence=sequence, offset=offset, filled=filled[sequence], gap=used - lower_bound(lengths, capacity)
    )


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
    partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS,
) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `gap` says how many sequences the piece's partition uses over its lower bound: 0 is
    certified to be as few as there can be. So are full sequences, which leave a partition
    that has a gap. `part` numbers the partition with its turn; whole pieces have none.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(token_pieces(docs, tokenizer_path, capacity), "pieces")
    loose = pieces.where(F.col("length") < capacity).select("number", "length")
    settled = []
    before = None  # what the loose pieces are packed into so far, and its number of sequences
    for turn in range(rounds + 1):
        # What partitions exchange goes to fewer ones, of twice as many pieces each round.
        parts = max(1, -(-loose.count() // (partition_pieces << turn)))
        dealt = loose.withColumn("part", F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(parts)))
        packed = dealt.groupBy("part").applyInPandas(lambda rows: _pack(rows, capacity), PACKED)
        packed = scratch.table(packed.withColumn("turn", F.lit(turn)), f"packed-{turn}")
        used = packed.where("offset = 0").count()
        if before is not None and used >= before[1]:
            settled.append(before[0])  # the exchange saved nothing
            break
        again = (F.col("gap") > 0) & (F.col("filled") < capacity)
        settled.append(packed.where(~again).withColumn("gap", F.lit(0).cast("long")))
        before = packed.where(again), packed.where(again & (F.col("offset") == 0)).count()
        if turn == rounds or before[1] < 2:
            settled.append(before[0])
            break
        loose = before[0].select("number", "length")
    placed = settled[0]
    for more in settled[1:]:
        placed = placed.unionByName(more)
    # Two tasks' numbers never meet: turn, partition and sequence each have bits of their own.
    sequence_id = F.col("turn") * F.lit(1 << 58) + F.col("part") * F.lit(1 << 26) + F.col("sequence")
    part = F.col("turn") * F.lit(1 << 32) + F.col("part")
    placed = placed.select("number", sequence_id.alias("sequence_id"), "offset", "gap", part.alias("part"))
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (F.lit(-1).cast("long") - F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"), F.lit(None).cast("long").alias("part"),
    )
    cut_off = pieces.where(F.col("length") < capacity).join(placed, "number")
    return whole.unionByName(cut_off).drop("number")


def gaps(packed: DataFrame) -> DataFrame:
    """One row: n_sequences, n_gaps (partitions above their bound) and n_above, by how many sequences.

    No packing of these pieces that keeps to the partitions has fewer than n_sequences -
    n_above sequences.
    """
    parts = packed.groupBy("part").agg(F.max("gap").alias("gap"))
    counted = parts.agg(F.count_if(F.col("gap") > 0).alias("n_gaps"), F.coalesce(F.sum("gap"), F.lit(0)).alias("n_above"))
    used = packed.agg(F.count_if(F.col("offset") == 0).alias("n_sequences"))
    return used.select("n_sequences", *(counted.select(c).scalar().alias(c) for c in ("n_gaps", "n_above")))
