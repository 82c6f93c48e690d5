"""Substring dedup against all 100-byte strings of a small corpus."""

import random

import numpy as np
import pytest
from llm_cases import data, docs_frame, stored

from salesloom.llm import suffix_dedup
from salesloom.llm.queries import QUERIES


def plain(docs, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each document."""
    least = {}
    for doc_id, text in docs:
        if doc_id is not None:
            for k in range(len(text) - length + 1):
                string = text[k : k + length]
                least[string] = min(doc_id, least.get(string, doc_id))
    result = []
    for doc_id, text in docs:
        gone, seen = bytearray(len(text)), set()
        for k in range(len(text) - length + 1):
            string = text[k : k + length]
            first = least.get(string)
            if string in seen or (first is not None and (doc_id is None or first < doc_id)):
                gone[k : k + length] = b"\x01" * length
            seen.add(string)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        result.append((doc_id, len(text), sum(gone), runs, bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(map(str, result))


def found(frame, length, gram):
    rows = suffix_dedup.remove_repeats(frame, length, gram).collect()
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in rows)


@pytest.mark.parametrize("length,gram", [(100, 51), (12, 7), (12, 6)])
def test_awkward_documents(spark, tmp_path, length, gram):
    docs = stored(docs_frame(spark), tmp_path)
    expected = plain([(r.doc_id, data(r.text)) for r in docs.collect()], length)
    assert found(docs, length, gram) == expected


def test_overlaps_and_near_matches(spark, tmp_path):
    rng = random.Random(8)
    letters = "abcd"
    parts = ["".join(rng.choice(letters) for _ in range(rng.randint(60, 260))) for _ in range(12)]
    texts = []
    for _ in range(120):
        text = ""
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(parts)
            cut = sorted(rng.sample(range(len(part) + 1), 2))
            text += part[cut[0] : cut[1]] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        texts.append(text)
    texts += ["ab" * 300, "a" * 99, "a" * 100, "a" * 101, "é" * 120]
    rows = [(k, t, "en", "s", 1, None, None, None) for k, t in enumerate(texts)]
    frame = stored(docs_frame(spark, rows), tmp_path)
    assert found(frame, 100, 51) == plain([(k, data(t)) for k, t, *_ in rows], 100)


def test_sf_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    expected = plain([(r.doc_id, data(r.text)) for r in docs.collect()], 100)
    assert found(docs, 100, 51) == expected
    rows = QUERIES["op8_suffix_dedup"](spark, tiny)
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_identifiers_stand_for_bytes():
    """Equal at a level if and only if the bytes are, wherever they lie."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(300)).encode() for _ in range(4)]
    by_level = [{}, {}, {}]
    for data in texts:
        text = suffix_dedup.Text(data, 12, 7)
        for family in (0, 1):
            starts = np.arange(len(data) - 12 - 5)
            found = text.level0(starts, family), text.level1(starts, family), text.level2(starts, starts + 5, family)
            for level, (ids, n) in enumerate(zip(found, (7, 12, 17))):
                for k, i in enumerate(ids.tolist()):
                    assert by_level[level].setdefault((family, i), data[k : k + n]) == data[k : k + n]
    assert all(len({k for k in level if k[0] == f}) == len(set(level.values())) for level in by_level for f in (0, 1))


def test_runs_share_their_anchor():
    rng = random.Random(4)
    data = "".join(rng.choice("abc") for _ in range(2000)).encode()
    text = suffix_dedup.Text(data, 100, 51)
    first, last, at = text.runs()
    assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
    for lo, hi, a in zip(first, last, at):
        for s in (lo, hi):
            assert text.grams[a] == text.grams[s : s + 50].min() and s <= a < s + 50
    with pytest.raises(ValueError):
        suffix_dedup.Text(data, 100, 49)


def test_last_ids_and_nulls_remove_nothing(spark, tmp_path):
    passage = "a passage that is long enough to be removed when an earlier document has it as well as this one does, " * 2
    rows = [(None, passage), (None, passage), (2**63 - 1, passage)]
    for more, removed in (([], 0), ([(7, passage)], 3)):
        frame = stored(docs_frame(spark, [(d, t, "en", "s", 1, None, None, None) for d, t in rows + more]), tmp_path)
        found = suffix_dedup.remove_repeats(frame).collect()
        assert sum(r.n_removed == r.n_bytes for r in found) == removed


def test_empty(spark, tmp_path):
    assert suffix_dedup.remove_repeats(stored(docs_frame(spark, []), tmp_path)).count() == 0
