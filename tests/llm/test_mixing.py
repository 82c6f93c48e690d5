"""Mixing: targets against a plain water filling, samples by their balance."""

from collections import defaultdict

import numpy as np
import pandas as pd
from llm_cases import docs_frame, stored, words

from salesloom.llm import mixing
from salesloom.llm.queries import QUERIES


def plain_targets(sizes):
    """Source -> target; excess is reshared by weight until no target is above three times its source's size."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    while True:
        excess = sum(max(0, target[s] - 3 * sizes[s]) for s in names)
        if excess <= 1e-6:
            return target
        target = {s: min(target[s], 3 * sizes[s]) for s in names}
        free = [s for s in names if target[s] < 3 * sizes[s]]
        if not free:
            return target
        for s in free:
            target[s] += excess * weight[s] / sum(weight[f] for f in free)


def check(rows, longest_share=1.0):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert 0 <= r.taken <= 3 * r.size
    for source, wanted in plain_targets(dict(sizes)).items():
        assert abs(target[source] - wanted) <= 1e-6 * max(1, wanted)
        longest = max(r.size for r in rows if r.source == source)
        assert abs(taken[source] - wanted) <= longest * longest_share + 1
    return taken


def test_awkward_documents(spark, tmp_path):
    docs = stored(docs_frame(spark), tmp_path)
    rows = mixing.mix(docs).collect()
    assert sorted(str((r.doc_id, r.source, len(words(r.text)))) for r in docs.collect()) == sorted(
        str((r.doc_id, r.source, r.size)) for r in rows
    )
    check(rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    copies = mixing.take_copies(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r.copies for r in rows)
    assert sum(len(words(r.text)) for r in copies.collect()) == sum(r.taken for r in rows)


def test_many_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(mixing.draw, "__defaults__", (16,))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(mixing.mix(docs).collect(), 0.1)


def test_query(spark, small):
    rows = QUERIES["op2_mixing"](spark, small)
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert rows.count() == 1000


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, chance = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    ended = mixing.fly(size, chance, rng.random(500))
    assert ((ended > 0) & (ended < 1)).sum() <= 2
    assert abs(ended.sum() - chance.sum()) < 1e-6 and abs(ended @ size - chance @ size) < 1e-3
    same = mixing.fly(np.full(9, 5.0), np.full(9, 1 / 3), rng.random(9))
    assert abs(same.sum() - 3) < 1e-9


def test_flight_is_unbiased():
    size = np.array([1.0, 5, 9, 30, 2, 7])
    chance = np.array([0.2, 0.5, 0.3, 0.6, 0.4, 0.8])
    rng = np.random.default_rng(4)
    mean = np.mean([mixing.fly(size, chance, rng.random(6)) for _ in range(6000)], axis=0)
    assert np.abs(mean - chance).max() < 0.03


def drawn(size, chance, ids, seed, block_rows):
    """`draw` without Spark: blocks of each turn by a hash, what they leave in the next."""
    from salesloom.llm.common import mix as scramble

    rows = pd.DataFrame({"row_id": ids, "source": "s", "size": size, "chance": chance})
    rows["draw"] = scramble(scramble(ids.astype(np.uint64)) + np.uint64(seed)).view(np.int64)
    ended, turn = [], 0
    while True:
        blocks = -(-len(rows) // block_rows)
        block = scramble(rows["draw"].to_numpy().view(np.uint64) + np.uint64(turn * 977 + 5)) % np.uint64(blocks)
        flown = pd.concat([mixing._flight(blocks == 1, turn)(part) for _, part in rows.groupby(block)])
        if blocks == 1:
            return pd.concat([*ended, flown]).set_index("row_id")["chance"].loc[ids].to_numpy()
        between = (flown["chance"] > 0) & (flown["chance"] < 1)
        ended.append(flown[~between])
        rows, turn = flown[between], turn + 1


def test_draw_is_unbiased():
    """Through blocks and turns, with heavy sizes: no document is taken more or less often than its chance says."""
    rng = np.random.default_rng(7)
    n, seeds = 400, 2000
    size = np.r_[rng.integers(1, 60, n - 20), rng.integers(3000, 20000, 20)].astype(float)
    chance, ids = np.full(n, 0.3), rng.permutation(n)
    flown = np.zeros(n)
    for seed in range(seeds):
        flown += drawn(size, chance, ids, seed, 64)
    z = (flown / seeds - chance) / np.sqrt(chance * (1 - chance) / seeds)
    by_size = np.argsort(size)
    free = by_size[3 * mixing.LANDING :]  # the shortest ones land, where the error decides
    assert np.sqrt(np.mean(z[free] ** 2)) < 1.05
    assert np.abs(z[free]).max() < 4
    assert np.abs(z[by_size[-20:]]).max() < 4


def test_flights_of_a_block_are_unbiased():
    rng = np.random.default_rng(8)
    n, seeds = 200, 2000
    rows = pd.DataFrame({"row_id": np.arange(n), "source": "s", "size": rng.integers(1, 5000, n).astype(float), "chance": 0.3})
    total = np.zeros(n)
    for turn in (0, 3):
        total[:] = 0
        for seed in range(seeds):
            rows["draw"] = np.random.default_rng([turn, seed]).integers(-(2**63), 2**63 - 1, n)
            total += mixing._flight(False, turn)(rows).set_index("row_id")["chance"].loc[np.arange(n)].to_numpy()
        z = (total / seeds - 0.3) / np.sqrt(0.3 * 0.7 / seeds)
        assert np.sqrt(np.mean(z**2)) < 1.05 and np.abs(z).max() < 4


def test_clashing_names(spark, tmp_path):
    names = "doc_id long, text string, source string, row int, row_ int, copies int, _copies int, _copy int, _row int, col int"
    frame = stored(spark.createDataFrame([(k, f"w {k}", "s", 1, 2, 3, 4, 5, 6, 7) for k in range(9)], names), tmp_path)
    copies = mixing.take_copies(frame)
    assert copies.columns == frame.columns
    assert {tuple(r)[3:] for r in copies.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


def test_empty(spark, tmp_path):
    assert mixing.mix(stored(docs_frame(spark, []), tmp_path)).count() == 0
