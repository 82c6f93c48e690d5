"""Packing: an exact round trip of the pieces, valid sequences, and bounds that hold."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import awkward_docs, docs_frame
from tokenizers import Tokenizer

from salesloom.llm import packing
from salesloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(tokenizer_path())


def ids(encoded):
    return np.frombuffer(encoded, dtype="<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=st.lists(st.one_of(
    st.sampled_from([" ", "  ", "\n", "\t ", "\u00a0", "\u2003", "\x1c", "'s", "'re ", "<|endoftext|>", " a", "b1 ", "..", "é", "ﬀ", "123"]),
    st.text(max_size=4),
), max_size=14).map("".join))
def test_ids_are_the_tokenizers_ids(plain, encoder, text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(encoder(text)) == plain(text)


@pytest.mark.parametrize("start", range(0, 0x530, 0x60))
def test_ids_of_each_letter_of_the_fast_path(plain, encoder, start):
    letters = [chr(c) for c in [*range(start, min(start + 0x60, 0x530)), *range(0x2000, 0x2070)]]
    text = "".join(f"{c} a{c}b {c}{c}1{c}" for c in letters)
    assert ids(encoder(text)) == plain(text)


@pytest.mark.parametrize("run", [" " * 1_100_000, "\n" * 1_000_100, "\t \n" * 400_000, "\u2003" * 5000, "a" * 300_000, "!" * 200_000])
def test_ids_of_long_runs(plain, encoder, run):
    for text in (run, f"some words{run}and more", f"{run} end"):
        assert ids(encoder(text)) == plain(text)


def test_what_the_fast_encoder_cannot_take(plain, encoder, monkeypatch):
    class Panics:
        def encode_ordinary(self, text):
            raise type("PanicException", (BaseException,), {})("stack overflow")

    monkeypatch.setattr(encoder, "fast", Panics())
    assert ids(encoder("some plain text")) == plain("some plain text")


def test_ids_of_documents(spark, plain, encoder, small):
    for row in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(300).collect():
        assert ids(encoder(row.text)) == plain(row.text)


@pytest.mark.parametrize("rounds,partition", [(3, 20_000), (3, 25), (0, 25)])
def test_pieces_and_sequences(spark, plain, rounds, partition):
    docs = docs_frame(spark)
    rows = packing.pack(docs, tokenizer_path(), partition_pieces=partition, rounds=rounds).collect()
    wanted = []
    for doc_id, text, *_ in awkward_docs():
        all_ids = [*plain(text), 2]
        lengths = [len(all_ids) % 1024 or 1024] if len(all_ids) > 1024 else [len(all_ids)]
        lengths += [1024] * ((len(all_ids) - lengths[0]) // 1024)
        start = 0
        for piece, length in enumerate(lengths):
            crc = zlib.crc32(np.array(all_ids[start : start + length], dtype="<u4").tobytes())
            wanted.append((doc_id, piece, start, length, crc))
            start += length
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) >= packing.lower_bound(np.array([w[3] for w in wanted]))


def test_long_blank_text_in_a_job(spark, plain):
    text = "begin" + " " * 1_000_100 + "end"
    rows = packing.pack(docs_frame(spark, [(1, text, "en", "s", 1, None, None, None)]), tokenizer_path()).collect()
    assert sum(r.length for r in rows) == len(plain(text)) + 1


def test_gaps_are_told(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "a " * int(n), "en", "s", 1, None, None, None) for k, n in enumerate(rng.integers(200, 420, 400))]
    for rounds in (0, 3):
        packed = packing.pack(docs_frame(spark, rows), tokenizer_path(), partition_pieces=20, rounds=rounds)
        told, lengths = packing.gaps(packed).first(), np.array([r.length for r in packed.collect()])
        assert told.n_sequences == packed.select("sequence_id").distinct().count()
        assert 0 <= told.n_gaps <= told.n_above <= told.n_sequences - packing.lower_bound(lengths) + 20
    assert packing.gaps(packing.pack(docs_frame(spark, []), tokenizer_path())).first() == (0, 0, 0)


def test_bound_composes_its_functions():
    """Lengths that neither family alone bounds as well as one on top of the other."""
    lengths = np.array([51] * 6 + [34] * 9 + [10] * 5)
    count = np.bincount(lengths, minlength=101)
    size = np.arange(101)

    def raised(t):
        return np.where(size > 100 - t, 100, np.where(size < t, 0, size))

    def rounded(x, k):
        return np.where((k + 1) * x % 100 == 0, x * k, (k + 1) * x // 100 * 100) / k

    best = max(np.ceil(count @ rounded(raised(t), k) / 100 - 1e-9) for t in range(51) for k in range(1, 13))
    assert packing.lower_bound(lengths, 100) >= best


def test_exchange_saves_sequences(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "a " * int(n), "en", "s", 1, None, None, None) for k, n in enumerate(rng.integers(200, 420, 400))]
    used = [
        packing.pack(docs_frame(spark, rows), tokenizer_path(), partition_pieces=20, rounds=n).select("sequence_id").distinct().count()
        for n in (0, 4)
    ]
    assert used[1] < used[0]


@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_never_above_the_best(lengths):
    def best(left, rooms):
        if not left:
            return len(rooms)
        found = len(lengths)
        for k in {rooms.index(r) for r in set(rooms) if r >= left[0]}:
            found = min(found, best(left[1:], sorted(rooms[:k] + [rooms[k] - left[0]] + rooms[k + 1 :])))
        return min(found, best(left[1:], sorted(rooms + [20 - left[0]])))

    sizes = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    optimum = best(sizes.tolist(), [])
    assert packing.lower_bound(sizes, 20) <= optimum
    sequence, _ = packing.best_fit_decreasing(sizes, 20)
    assert len(set(sequence.tolist())) >= optimum


def test_empty(spark):
    assert packing.pack(docs_frame(spark, []), tokenizer_path()).count() == 0
