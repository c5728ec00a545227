"""Positions, running totals and skewed joins against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from traceaudit.operators.lookup import hot_cold_join, lookup_join
from traceaudit.operators.ranking import globally_ranked, pick_first, pick_last, ranked, running_max, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; one key is null."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), i, rng.randint(-50, 50)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "k string, i int, v int").repartition(7)


def by_key(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, v))
    return out


def test_ranked(skewed):
    rows, df = skewed
    got = {(r.k, r.i): (r.p, r.n) for r in ranked(df, ["k"], ["i"], F.floor(F.col("i") / 16), "p", "n").collect()}
    want = {(k, i): (at + 1, len(items)) for k, items in by_key(rows).items() for at, (i, _) in enumerate(items)}
    assert got == want


def test_running_values(skewed):
    rows, df = skewed
    bucket = F.floor(F.col("i") / 16)
    sums = {r.i: r.s for r in running_sum(df, ["k"], ["i"], bucket, F.col("v"), "s").collect()}
    tops = {r.i: r.m for r in running_max(df, ["k"], ["i"], bucket, F.col("v"), "m").collect()}
    for items in by_key(rows).values():
        for at, (i, _) in enumerate(items):
            before = [v for _, v in items[:at]]
            assert sums[i] == sum(before)
            assert tops[i] == (max(before) if before else None)


def test_global_rank(skewed):
    rows, df = skewed
    got = [(r.v, r.i, r.pos, r.n) for r in globally_ranked(df, ["v", "i"], total="n").collect()]
    want = [(v, i, at + 1, 500) for at, (v, i) in enumerate(sorted((v, i) for _, i, v in rows))]
    assert sorted(got, key=lambda r: r[2]) == want


def test_pick(skewed):
    rows, df = skewed
    first = {r.k: r.i for r in pick_first(df, ["k"], [F.col("v"), F.col("i")], ["i", "v"]).collect()}
    last = {r.k: (r.i, r.n) for r in pick_last(df, ["k"], [F.col("v"), F.col("i")], ["i"], {"n": F.count("*")}).collect()}
    for k, items in by_key(rows).items():
        assert first[k] == min((v, i) for i, v in items)[1]
        assert last[k] == (max((v, i) for i, v in items)[1], len(items))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [10, 0])
def test_lookup_join_same_result_beyond_the_limit(spark, skewed, limit, how):
    rows, df = skewed
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, d int")
    out = lookup_join(df, dim, ["k"], how, broadcast_bytes=limit)
    got = sorted(((r.i, r.d) for r in out.collect()))
    known = {"hot": 1, "a": 2}
    assert got == sorted((i, known.get(k)) for k, i, _ in rows if how == "left" or k in known)


def test_only_cold_keys_are_shuffled(skewed, spark):
    _, df = skewed
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, d int")
    hot_rows = df.groupBy("k").count().filter(F.col("count") * 3 > df.count()).collect()
    assert [r.k for r in hot_rows] == ["hot"]
    out = hot_cold_join(df, dim, ["k"], "inner", share=3)
    assert out.count() == df.filter("k in ('hot', 'a')").count()
    assert "LeftAnti" in out._jdf.queryExecution().toString()
