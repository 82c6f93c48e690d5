"""Stupid backoff against a plain loop for several orders, and the query against SQL."""

import math
from collections import Counter

import pytest
from llm_cases import docs_frame, words
from oracle_check import compare, duck
from pyspark.sql import functions as F

from salesloom.llm import lm_scoring
from salesloom.llm.queries import ORACLE, QUERIES


def plain_scores(texts, order):
    split = [[w.lower() for w in words(t)] for t in texts]

    def grams(ws):
        return Counter(tuple(ws[k : k + n]) for n in range(1, order + 1) for k in range(len(ws) - n + 1))

    total, n_words = sum((grams(ws) for ws in split), Counter()), sum(map(len, split))
    scores = []
    for ws in split:
        own, log = grams(ws), 0.0

        def other(gram):
            return total[gram] - own[gram]

        def score(gram):
            if len(gram) == 1:
                return max(other(gram), 1) / max(n_words - len(ws), 1)
            return other(gram) / other(gram[:-1]) if other(gram) else 0.4 * score(gram[1:])

        for k in range(len(ws)):
            log += math.log(score(tuple(ws[max(0, k - order + 1) : k + 1])))
        scores.append((len(ws), log))
    return scores


@pytest.mark.parametrize("order,size", [(1, 1 << 20), (2, 2_000), (3, 2_000), (4, 20_000)])
def test_awkward_documents(spark, order, size):
    rows = docs_frame(spark).collect()
    expected = sorted((str(r.doc_id), n, round(s, 6)) for r, (n, s) in zip(rows, plain_scores([r.text for r in rows], order)))
    found = lm_scoring.score(docs_frame(spark), order, chunk_bytes=size).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in found) == expected


def test_query_equals_sql(spark, small):
    rows, differences = compare(QUERIES["op9_lm_scoring"](spark, small), duck(small), ORACLE["op9_lm_scoring"])
    assert rows == 1000
    assert differences == []


def test_chunks_equal_sql(spark, small):
    """Many chunks, so that all counts cross chunks and longer n-grams are asked for by their parts."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scored = lm_scoring.score(docs, chunk_bytes=50_000).withColumn("log_score", F.round("log_score", 4))
    rows, differences = compare(scored, duck(small), ORACLE["op9_lm_scoring"])
    assert rows == 1000
    assert differences == []


def test_asked_once(spark, small):
    """Count table and join read one shuffle, and all passes one shuffle of the texts."""
    scored = lm_scoring.score(spark.read.parquet(f"{small}/documents.parquet"), chunk_bytes=50_000)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(exchanges) == 5  # texts, and for each of two passes what is asked and answered


def test_empty(spark):
    assert lm_scoring.score(docs_frame(spark, [])).count() == 0
