"""Phrase mining against plain counting, and the query against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward_docs, docs_frame
from oracle_check import compare, duck

from salesloom.llm import collocations
from salesloom.llm.queries import ORACLE, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(docs, least, longest=5, top=2000):
    """Counts of everything, then the rules one by one."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    rows = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                inside |= {p[k : k + m] for k in range(len(p) - m + 1) if 100 * a >= 100 * found[p[k : k + m]]}
        ranked = []
        for p, a in candidates.items():
            if p in inside:
                continue
            n = totals[lang]
            score, _, left, right = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right, n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(ranked)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def found(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def phrased_docs():
    """Phrases that recur within and across pieces, in several languages."""
    rng = random.Random(8)
    fixed = ["once upon a time", "Upon A", "the the the the", "ü ber alles", "a time ago.", "x\ty  z", "of the people"]
    rows = []
    for k in range(300):
        text = "".join(rng.choice(fixed + [f"w{rng.randrange(30)}"]) + rng.choice([" ", " ", " ", ", ", "\n", "\r\n", "\x0b"]) for _ in range(60))
        rows.append((k, text, rng.choice(["en", "en", "de", None, "und", ""]), "s", 1, "k", 1, "b"))
    return rows


@pytest.mark.parametrize("least, longest", [(100, 5), (30, 5), (20, 2), (25, 3)])
def test_phrases(spark, least, longest):
    docs = phrased_docs()
    result = collocations.collocations(docs_frame(spark, docs), least=least, longest=longest)
    assert result.columns == COLUMNS
    expected = plain([(lang, text) for _, text, lang, *_ in docs], least, longest)
    assert len(expected) > 20
    assert found(result) == expected


def test_awkward_documents(spark):
    docs = awkward_docs()
    expected = plain([(lang, text) for _, text, lang, *_ in docs], 5)
    assert found(collocations.collocations(docs_frame(spark, docs), least=5)) == expected
    assert found(collocations.collocations(docs_frame(spark, docs), least=5, top=3)) == [r for r in expected if r[1] <= 3]


def test_empty_tables(spark):
    assert collocations.collocations(docs_frame(spark, [])).count() == 0
    nothing = [(1, None, None, None, None, None, None, None), (2, " .,", "en", None, None, None, None, None)]
    assert collocations.collocations(docs_frame(spark, nothing), least=1).count() == 0


class Sent:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


EVERYTHING = Sent(b"\xff" * 1024)


def test_runs_are_whole_however_small_the_bounds(monkeypatch):
    """Bursts, spills and parts of texts change how counts leave a task, not what they add up to."""
    texts = [(lang or "und", text.encode()) for _, text, lang, *_ in phrased_docs()]
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts], pa.binary())], names=["lang", "data"])
    expected = Counter()
    for lang, text in texts:
        for words in pieces(text.decode()):
            expected[lang, b""] += len(words)
            for m in range(1, 6):
                expected.update((lang, " ".join(words[k : k + m]).encode()) for k in range(len(words) - m + 1))

    def counted():
        total = Counter()
        where = defaultdict(set)
        for runs in collocations.phrase_counter(5, 256, EVERYTHING, EVERYTHING)([batch]):
            for run in runs.to_pylist():
                phrases = run["phrases"].split(b"\n")
                assert phrases == sorted(phrases)
                total.update(dict(zip(((run["lang"], p) for p in phrases), np.frombuffer(run["counts"], dtype="<i8").tolist())))
                for phrase in phrases:
                    where[run["lang"], phrase].add(run["range"])
        assert all(len(ranges) == 1 for ranges in where.values()) and len(set.union(*where.values())) > 100
        return total

    def sketches():
        words, pairs = Counter(), Counter()
        for total, work in ((words, collocations.word_sketch(256, 100)), (pairs, collocations.pair_sketch(256, 100, EVERYTHING))):
            for sketch in work([batch]):
                for part, hashes, counts in zip(*(sketch.column(k).to_pylist() for k in range(3))):
                    for k, n in enumerate(counts):
                        total[part << 40 | int.from_bytes(hashes[5 * k : 5 * k + 5], "little")] += n
        return words, pairs

    def hashes(lang, phrase):
        first = np.array([collocations.word_hash(lang, w) for w in phrase.split(b" ")], dtype=np.uint64)
        return int(first[0]) if len(first) == 1 else int(collocations.pair_hash(first[:1], first[1:])[0])

    by_hash = [{hashes(*key): n for key, n in expected.items() if key[1] and key[1].count(b" ") == m} for m in (0, 1)]
    assert counted() == expected
    for total, right in zip(sketches(), by_hash):
        assert total == {h: min(n, 100) for h, n in right.items()}
    for name, value in [("BURST", 3), ("MOST_ENTRIES", 200), ("BATCH_WORDS", 50), ("PART_BYTES", 64), ("MOST_HASHES", 99), ("MOST_WORDS", 60)]:
        monkeypatch.setattr(collocations, name, value)
        assert counted() == expected
        for total, right in zip(sketches(), by_hash):
            assert total.keys() == right.keys()
            assert {h for h, n in total.items() if n >= 100} == {h for h, n in right.items() if n >= 100}


def test_large_numbers(spark):
    """Products beyond 64 bits are exact, on both sides of a whole number."""
    a, l, r, n = 10**12, 3 * 10**12, 10**13 - 1, 10**16 + 7
    counts = [("en", "x y", a), ("en", "x", l), ("en", "y", r), ("en", "p q", 300), ("en", "p", 300), ("en", "q", 10**9)]
    counts = spark.createDataFrame(counts, "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    scores = {row.phrase: row.score for row in collocations.scored(counts, totals).collect()}
    assert scores == {"x y": 1000 * a * n // (l * r), "p q": 1000 * 300 * n // (300 * 10**9)}


def test_query_equals_sql(spark, small):
    rows, differences = compare(QUERIES["op12_collocations"](spark, small), duck(small), ORACLE["op12_collocations"])
    assert rows > 50
    assert differences == []
