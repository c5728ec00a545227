"""Mergeable summaries in place of shuffles of all rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceaudit.operators import agreement, evaluate, graph, judging, sampling, signatures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed, runs", [(0, 3), (1, 40)])
def test_open_calls_equal_the_anti_join(spark, seed, runs):
    rng = random.Random(seed)
    judges = ["J", "K", "L", "M"]
    done = [(rng.choice([*"abcde", None]), rng.choice([*judges, "other"]), rng.choice(["j1", "j2", "j3"]), rng.choice([None, -1, 0, 1, 2, 39, 40]),
             rng.choice(["x", "ERROR", None])) for _ in range(150)]
    ledger = spark.createDataFrame(done, "trace_id string, judge_model string, stage string, run_idx long, judgment string")
    sample = spark.createDataFrame([(t,) for t in "abcdefgaa"], "trace_id string")
    for retry in (False, True):
        good = {d[:4] for d in done if not (retry and d[4] in ("ERROR", "CONFIG_ERROR", "PARSE_ERROR"))}
        want = {c for c in itertools.product("abcdefg", judges, ("j1", "j2"), range(runs)) if c not in good}
        got = judging.pending_judgments(sample, judges, ledger, runs, retry)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    keys = [line for line in plan(got).splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("judge_model" in line or "stage" in line for line in keys)


def test_a_run_that_always_rises(spark):
    rows = spark.createDataFrame([("r", i, i * 0.0007) for i in range(3000)] + [("s", i, -float(i)) for i in range(50)], "run_id string, step long, m double")
    out = evaluate.early_stop(rows, F.col("m"), patience=5, bucket_size=100)
    assert "collect_list" not in plan(out)
    best, at = 0.0, 0
    for epoch in range(1, 3001):
        if epoch - at > 5:
            break
        if (epoch - 1) * 0.0007 > best + 0.001:
            best, at = (epoch - 1) * 0.0007, epoch
    got = {r.run_id: (r.best_epoch, r.best_metric, r.last_epoch, r.stopped_early) for r in out.collect()}
    assert got["r"] == (at, best, 3000 if 3000 < at + 5 else at + 5, 3000 >= at + 5)
    assert got["s"] == (0, 0.0, 5, True)


@pytest.mark.parametrize("tracked, spare", [(1000, 4), (64, 1), (16, 1)])
def test_frequent_terms_equal_all_counted(spark, tracked, spare):
    rng = random.Random(3)
    docs = [(i, [f"t{min(int(rng.paretovariate(0.9)), 3000)}" for _ in range(rng.randrange(40))]) for i in range(300)]
    lists = spark.createDataFrame(docs, "id long, terms array<string>")
    for limit, share in ((5, 0.9), (20, 0.3), (60, 0.05)):
        want = [tuple(r) for r in signatures.vocabulary(lists, limit, share).collect()]
        assert [tuple(r) for r in signatures.frequent_vocabulary(lists, limit, share, tracked, spare).collect()] == want
    assert signatures.frequent_vocabulary(lists.limit(0), 5).count() == 0


def test_frequent_terms_read_the_lists_twice(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def terms(i):
        made.add(1)
        return [f"t{k}" for k in range(1, 9) for _ in range(i % k)]

    lists = spark.range(0, 200, 1, 4).select("id", terms("id").alias("terms"))
    got = [(r.term, r.tf, r.df, r.docs) for r in signatures.frequent_vocabulary(lists, 3, 0.95).collect()]
    assert got == [(f"t{k}", sum(i % k for i in range(200)), sum(i % k > 0 for i in range(200)), 200) for k in (8, 7, 6)]
    assert made.value <= 600                                # once to count, once for the sketch and once for its filter of empty lists


@pytest.mark.parametrize("kind", ["gcn", "sage"])
def test_layers_are_powers(spark, kind):
    rng = np.random.default_rng(2)
    n, width, layers = 12, 5, 3
    x = rng.normal(size=(n, width))
    links = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2)) if a != b})
    nodes = spark.createDataFrame([("t", i, x[i].tolist()) for i in range(n)], "trace_id string, node_idx long, features array<double>")
    edges = spark.createDataFrame([("t", a, b) for a, b in links], "trace_id string, src_idx long, dst_idx long")
    a = np.zeros((n, n))
    for s, d in links:
        a[d, s] = 1
    want = x
    if kind == "gcn":
        degree = a.sum(axis=1) + 1
        a = (a + np.eye(n)) / np.sqrt(np.outer(degree, degree))
        want = np.linalg.matrix_power(a, layers) @ x
    else:
        for _ in range(layers):
            mean = a @ want / np.maximum(a.sum(axis=1, keepdims=True), 1)
            size = np.linalg.norm(mean, axis=1, keepdims=True)
            want = np.divide(mean, size, out=np.zeros_like(mean), where=size > 0)
    got = {r.node_idx: r.features for r in graph.propagate_layers(nodes, edges, width, kind, layers).collect()}
    assert np.allclose([got[i] for i in range(n)], want)
    once = {r.node_idx: r.features for r in graph.propagate(nodes, edges, width, kind).collect()}
    assert np.allclose([once[i] for i in range(n)], [r.features for r in graph.propagate_layers(nodes, edges, width, kind, 1).orderBy("node_idx").collect()])


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_over_all_strata_equals_the_parts(spark, seed):
    rng = random.Random(seed)
    ids = [f"r{i}" for i in range(200)]
    traces = spark.createDataFrame([(i, "t", rng.choice(["V1", "V2", "V3"]), "c", "A", "soft") for i in ids],
                                   "run_id string, task_id string, violation_id string, violation_category string, target_agent string, designed_hard_soft string")
    labels = spark.createDataFrame([(i, rng.choice([True, False, None]), rng.choice([True, True, False]), rng.choice(["hard", "soft", "soft", None]), rng.choice(["x", "y", None]))
                                    for i in ids[:180]], "run_id string, accepted boolean, precheck_passed boolean, final_label string, rejection_reason string")
    controls = traces.limit(0).unionByName(spark.createDataFrame([(f"c{i}", "t", "V1", "control", "A", "none") for i in range(15)], traces.schema))
    full = traces.join(labels, "run_id", "left")
    accepted, down = full.filter("accepted"), full.filter("not accepted and precheck_passed")
    parts = [sampling.balanced_sample(accepted.filter("violation_id <> 'V3'"), "violation_id", "final_label", "run_id", 6),
             sampling.rejected_sample(down, "rejection_reason", "run_id", 11), sampling.control_sample(controls, "run_id", 4)]
    want = sorted(r.run_id for p in parts for r in p.collect())
    out = sampling.stratified_sample(traces, labels, controls, ["V1", "V2"], 6, 11, 4)
    assert sorted(r.run_id for r in out.collect()) == want


def test_bounds_of_multinomial_replicates_are_those_of_drawn_indexes(spark):
    rng = random.Random(1)
    verdicts = [(f"t{i}", judge, rng.choice(["policy_absent", "policy_absent", "policy_present"]), "no_violation", False, None) for i in range(120) for judge in ("J", "K")]
    rows = spark.createDataFrame(verdicts, "trace_id string, judge_model string, j1_consensus string, j2_consensus string, accepted boolean, hard_soft string")
    one = {r.stage: r for r in agreement.kappa_bootstrap(rows, ["J", "K"], replicates=1000).collect()}
    two = {r.stage: r for r in agreement.kappa_bootstrap(rows, ["J", "K"], replicates=1000, method="index").collect()}
    assert one["j1"].replicates_used == two["j1"].replicates_used == 1000 and one["j1"].kappa == pytest.approx(two["j1"].kappa)
    assert one["j1"].ci_low == pytest.approx(two["j1"].ci_low, abs=0.04) and one["j1"].ci_high == pytest.approx(two["j1"].ci_high, abs=0.04)
    assert one["j1"].ci_low < one["j1"].kappa < one["j1"].ci_high
