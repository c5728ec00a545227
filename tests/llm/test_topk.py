import math

import numpy as np

from traceaudit.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, set()).add(tuple(math.floor(64 * float(np.float32(x))) for x in v))
    flat = [(i, v) for i, vs in good.items() for v in vs]
    out = set()
    for i, q in flat:
        if i % every == 0:
            scores = sorted({(-sum(a * b for a, b in zip(q, v)), j) for j, v in flat if j != i})[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def run(spark, rows, every=5, k=4):
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    return [tuple(r) for r in topk.top_inner_products(table, every, k).collect()]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=24) * rng.exponential()]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 24) for i in range(60)]                     # one common vector
    rows += [(7, rows[7][1]), (2001, None), (2005, [float("nan")] * 24), (2006, [float("inf")] + [0.0] * 23), (2007, [None] * 24), (None, [0.1] * 24), (2010, [0.0] * 24)]
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5, 4)


def test_few_rows_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, [-1.0, 0.25, 9.0]), (20, [])]
    assert sorted(run(spark, rows, 20, 20)) == [(0, 1, 1, 192 * 64), (0, 2, 20, 0), (0, 3, 2, -64 * 64 + 128 * 16), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_large_numbers_are_exact():
    q = np.array([[2.0 ** 30 + 1, 3.0]])
    x = np.array([[2.0 ** 30 + 3, 5.0], [-(2.0 ** 32), 1.0]])
    assert topk._scores(q, x).tolist() == [[(2 ** 30 + 1) * (2 ** 30 + 3) + 15, -(2 ** 30 + 1) * 2 ** 32 + 3]]


def shipped(spark, monkeypatch, rows):
    """Pairs of blocks that are made, and the result."""
    counts, plain = [], topk.block_pairs

    def counted(*args):
        pairs = plain(*args)
        assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()
        counts.append(pairs.count())
        return pairs

    with monkeypatch.context() as m:
        m.setattr(topk, "BLOCK", 20)
        m.setattr(topk, "QUERY_BLOCK", 10)
        m.setattr(topk, "block_pairs", counted)
        got = run(spark, rows, 5, 4)
        return sum(counts), got


def test_pairs_are_left_out_before_they_are_made(spark, monkeypatch):
    rng = np.random.default_rng(5)
    units = rng.normal(size=(400, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    even = [(i, [float(x) for x in v]) for i, v in enumerate(units)]
    skewed = [(i, [float(x) * 30 / (1 + i) for x in v]) for i, v in enumerate(units)]
    all_pairs = 20 * 8                                                # blocks of candidates times blocks of queries
    made, got = shipped(spark, monkeypatch, even)
    assert set(got) == brute(even, 5, 4) and made <= all_pairs
    fewer, got = shipped(spark, monkeypatch, skewed)
    assert set(got) == brute(skewed, 5, 4) and fewer < all_pairs / 3


def test_negative_products_and_empty_lengths(spark, monkeypatch):
    rows = [(i, [-1.0 - i % 7, -0.5]) if i % 5 else (i, [1.0, 2.0 + i % 3]) for i in range(1, 90)] + [(100, [0.0, 0.0]), (105, [0.0, 0.0])]
    made, got = shipped(spark, monkeypatch, rows)
    assert set(got) == brute(rows, 5, 4) and len(got) == len(set(got))
