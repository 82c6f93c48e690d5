"""Line dedup against a plain loop over all windows, and the query against SQL."""

from collections import defaultdict

from llm_cases import docs_frame, stored
from oracle_check import compare, duck

from salesloom.llm import line_dedup
from salesloom.llm.queries import ORACLE, QUERIES


def cleaned(docs):
    first = defaultdict(set)
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        for k in range(len(lines) - 2):
            first[tuple(lines[k : k + 3])].add(doc_id)
    result = []
    for doc_id, text in docs:
        if text is None:
            result.append((doc_id, None, 0, 0))
            continue
        lines, seen, gone = text.split("\n"), set(), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if not "".join(window).strip(" \t\n\r\x0b\x0c"):
                continue
            known = [d for d in first[window] if d is not None]
            earlier = bool(known) and (doc_id is None or min(known) < doc_id)
            if earlier or window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        result.append((doc_id, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return result


def test_awkward_documents(spark, tmp_path):
    docs = stored(docs_frame(spark), tmp_path)
    rows = line_dedup.dedup_lines(docs).collect()
    expected = cleaned([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in rows) == sorted(map(str, expected))
    assert sum(r.n_removed for r in rows) > 20
    assert set(docs.columns) < set(rows[0].asDict())
    others = [c for c in docs.columns if c != "text"]
    assert sorted(str([r[c] for c in others]) for r in rows) == sorted(str([r[c] for c in others]) for r in docs.collect())


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = QUERIES["op1_line_dedup"](spark, small).collect()
    expected = cleaned([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in rows) == sorted(map(str, expected))


def test_query_equals_sql(spark, small):
    rows, differences = compare(QUERIES["op1_line_dedup"](spark, small), duck(small), ORACLE["op1_line_dedup"])
    assert rows == 1000
    assert differences == []


def test_empty(spark, tmp_path):
    assert line_dedup.dedup_lines(stored(docs_frame(spark, []), tmp_path)).count() == 0
