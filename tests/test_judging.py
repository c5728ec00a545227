"""Votes, verdicts, replies and agreement on small cases with known answers."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from traceaudit.operators import agreement, judging

A, P, H, S, N = "policy_absent", "policy_present", "hard_violation", "soft_violation", "no_violation"

CASES = {
    "agree": ([A, A, A], [S, S, S]), "j1_fails": ([P, P, A], [S, S, S]), "two_thirds": ([A, A, "ERROR"], [H, H, N]),
    "tie": ([A, A, A], [H, S, N]), "tie_soft": ([A, A, A], [S, H, N]), "below": ([A, A, A], [H, N, N]),
    "both": ([P, P, P], [N, N, N]), "nulls": ([A, None, A], [S, None, S]), "null_fails": ([A, None, P], [S, S, S]),
}


def ledger(spark, judge="J"):
    rows = [(t, judge, stage, i, v) for t, pair in CASES.items() for stage, votes in zip(("j1", "j2"), pair)
            for i, v in enumerate(votes)]
    return spark.createDataFrame(rows, "trace_id string, judge_model string, stage string, run_idx bigint, judgment string").repartition(5)


def test_cross_judge_consensus(spark):
    got = {r.trace_id: (r.j1_consensus, r.j2_consensus, r.accepted, r.hard_soft) for r in judging.consensus(ledger(spark)).collect()}
    assert got["agree"] == (A, S, True, "soft")
    assert got["j1_fails"] == (P, S, False, "soft")
    assert got["two_thirds"] == (A, H, True, "hard")
    assert got["tie"] == (A, H, True, "hard")
    assert got["tie_soft"] == (A, S, True, "soft")
    assert got["below"] == (A, N, False, None)
    assert got["both"] == (P, N, False, None)
    assert got["nulls"] == (A, S, True, "soft")
    assert got["null_fails"][0] == P


def test_single_run_verdicts(spark):
    traces = spark.createDataFrame([(t, True, "soft") for t in CASES] + [("gone", False, "hard"), ("silent", True, "hard")],
                                   "trace_id string, precheck_passed boolean, designed_hard_soft string")
    got = {r.trace_id: r for r in judging.trace_verdicts(traces, ledger(spark)).collect()}
    assert got["below"].j2_consensus == H and not got["below"].accepted and got["below"].reclassified
    assert got["below"].rejection_reason == "executional_violation_not_confirmed"
    assert got["j1_fails"].rejection_reason == "theoretic_violation_not_confirmed"
    assert got["both"].rejection_reason == "both_judges_failed" and got["both"].j2_unanimity_rate == 1.0
    assert got["gone"].j1_consensus == "n/a" and got["gone"].rejection_reason == "injection_failed_no_diff"
    assert got["gone"].j2_unanimity_rate == 0.0 and not got["gone"].reclassified
    assert got["silent"].rejection_reason == "both_judges_failed" and got["silent"].j1_agreement == 0.0
    assert got["two_thirds"].j1_agreement == pytest.approx(2 / 3)
    assert got["agree"].rejection_reason is None and not got["agree"].reclassified
    assert got["two_thirds"].reclassified


def test_threshold_parameter(spark):
    strict = judging.consensus(ledger(spark), threshold=1.0)
    got = {r.trace_id: r.accepted for r in strict.collect()}
    assert got["agree"] and not got["two_thirds"]


def test_pending_and_retry(spark):
    done = ledger(spark)
    sample = spark.createDataFrame([("two_thirds",), ("new",)], "trace_id string")
    assert judging.pending_judgments(sample, ["J"], done).count() == 6
    assert judging.pending_judgments(sample, ["J"], done, retry_errors=True).count() == 7
    assert judging.pending_judgments(sample, ["J", "K"], done, n_runs=2).count() == 12


REPLIES = [
    (1, '{"judgment": "policy_absent", "confidence": 0.5, "evidence": "e"}', "policy_absent", None),
    (2, '```json\n{"judgment": "a"}\n```', "a", None),
    (3, 'Well: {"judgment": "b", "evidence": "x {y} z"} done', "b", None),
    (4, '{"note": 1} then {"judgment": "c"}', "c", None),
    (5, '{"judgment": "d"', "PARSE_ERROR", "no valid JSON found"),
    (6, "", "PARSE_ERROR", "empty response"),
    (7, None, "PARSE_ERROR", "empty response"),
    (8, '{"judgment": "brace }", "evidence": "}"}', "brace }", None),
    (9, "[1, 2]", "PARSE_ERROR", "no valid JSON found"),
    (10, '```\n{"judgment": "f"}', "f", None),
    (11, '{"judgment": "g"} {"judgment": "h"}', "g", None),
]


def test_parse_verdicts(spark):
    rows = spark.createDataFrame([r[:2] for r in REPLIES], "id int, raw string")
    got = {r.id: (r.judgment, r.parse_error) for r in judging.parse_verdicts(rows).collect()}
    assert got == {r[0]: r[2:] for r in REPLIES}


def test_parse_any_object(spark):
    rows = spark.createDataFrame([(1, 'x {"note": 1} y {"judgment": "c"}')], "id int, raw string")
    assert judging.parse_verdicts(rows, expected=None).first().judgment is None
    assert judging.parse_verdicts(rows).first().judgment == "c"


def test_placeholders_in_texts_stay(spark):
    traces = spark.createDataFrame([("t", "V1", "A", "say {policy_text} now")],
                                   "trace_id string, violation_id string, target_agent string, modified_system_prompt string")
    pol = spark.createDataFrame([("V1", "A", "P{indicators}", "I")], "violation_id string, target_agent string, policy_text string, indicators string")
    out = judging.render_judge_prompts(traces, pol, {"j1": "<{policy_text}|{modified_system_prompt}>{{ok}}"}).first()
    assert out.prompt == "<P{indicators}|say {policy_text} now>{ok}"


def kappa(pairs):
    n = len(pairs)
    cats = {c for p in pairs for c in p}
    po = sum(a == b for a, b in pairs) / n
    pe = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in cats) / n / n
    return (po - pe) / (1 - pe)


def consensus_rows(spark, seed=1, n=60, judges=("X", "Y", "Z")):
    rng = random.Random(seed)
    rows = []
    for t in range(n):
        base = rng.choice([H, S, N])
        for j in judges:
            if rng.random() < 0.05:
                continue
            v = base if rng.random() < 0.7 else rng.choice([H, S, N])
            rows.append((t, j, rng.choice([A, P]), v, v != N, {H: "hard", S: "soft"}.get(v)))
    schema = "trace_id int, judge_model string, j1_consensus string, j2_consensus string, accepted boolean, hard_soft string"
    return rows, spark.createDataFrame(rows, schema)


def test_pairwise_kappa_by_hand(spark):
    rows, df = consensus_rows(spark)
    by = {(t, j): v for t, j, _, v, _, _ in rows}
    got = {(r.judge_a, r.judge_b): (r.kappa, r.n) for r in agreement.pairwise_kappa(df, ["X", "Y", "Z"], ["j2"]).collect()}
    for a, b in (("X", "Y"), ("X", "Z"), ("Y", "Z")):
        pairs = [(by[t, a], by[t, b]) for t in range(60) if (t, a) in by and (t, b) in by]
        assert got[a, b] == (pytest.approx(kappa(pairs)), len(pairs))
    swapped = {(r.judge_a, r.judge_b): r.kappa for r in agreement.pairwise_kappa(df, ["Z", "Y", "X"], ["j2"]).collect()}
    assert swapped["Y", "X"] == pytest.approx(got["X", "Y"][0])


def test_fleiss_textbook(spark):
    """Fleiss (1971) style case worked out by hand: 3 raters, 4 subjects."""
    table = [("a", "a", "a"), ("a", "b", "b"), ("b", "b", "b"), ("a", "a", "b")]
    rows = [(i, j, v, v, True, None) for i, vs in enumerate(table) for j, v in zip("XYZ", vs)]
    df = spark.createDataFrame(rows, "trace_id int, judge_model string, j1_consensus string, j2_consensus string, accepted boolean, hard_soft string")
    po = (1 + 1 / 3 + 1 + 1 / 3) / 4
    pe = (6 / 12) ** 2 + (6 / 12) ** 2
    got = agreement.fleiss_kappa(df, list("XYZ"), ["j1"]).first()
    assert got.kappa == pytest.approx((po - pe) / (1 - pe)) and got.n == 4


def test_degenerate_kappa_is_null(spark):
    rows = [(i, j, A, N, False, None) for i in range(5) for j in "XYZ"]
    df = spark.createDataFrame(rows, "trace_id int, judge_model string, j1_consensus string, j2_consensus string, accepted boolean, hard_soft string")
    assert all(r.kappa is None for r in agreement.pairwise_kappa(df, list("XYZ")).collect())
    assert all(r.kappa is None for r in agreement.fleiss_kappa(df, list("XYZ")).collect())
    boot = agreement.kappa_bootstrap(df, list("XYZ"), replicates=20).collect()
    assert all(r.ci_low is None and r.replicates_used == 0 for r in boot)


def test_bootstrap_methods_agree(spark):
    _, df = consensus_rows(spark, n=200)
    a = {(r.judge_a, r.judge_b): r for r in agreement.kappa_bootstrap(df, ["X", "Y"], ["j2"], 400, method="multinomial").collect()}
    b = {(r.judge_a, r.judge_b): r for r in agreement.kappa_bootstrap(df, ["X", "Y"], ["j2"], 400, method="index").collect()}
    for k in a:
        assert a[k].ci_low < a[k].kappa < a[k].ci_high
        assert math.isclose(a[k].ci_low, b[k].ci_low, abs_tol=0.04) and math.isclose(a[k].ci_high, b[k].ci_high, abs_tol=0.04)


def test_drawn_indexes_are_shared_and_spread(spark):
    _, df = consensus_rows(spark, n=200)
    cells = agreement.contingency(df, list("XYZ")).cache()
    keys = ["judge_a", "judge_b", "stage"]
    drawn = agreement._index_draws(cells, keys, 50, 42)
    # A stated number of tasks, which the adaptive planner does not join into one, and no row per draw in the plan.
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    sizes = {tuple(r[:3]): r.n for r in cells.groupBy(*keys).agg(F.sum("cell_n").alias("n")).collect()}
    sums = drawn.groupBy(*keys, "replicate").agg(F.sum("cell_n").alias("n")).collect()
    assert len(sums) == 50 * len(sizes) and all(r.n == sizes[tuple(r[:3])] for r in sums)
    lists = {tuple(r[:3]): (r.cells, r.n) for r in agreement._cell_lists(cells, keys).collect()}
    want = collections.Counter()
    for key, (held, n) in lists.items():
        spread = [(c.a, c.b) for c in held for _ in range(c.cell_n)]
        for i in range(n):
            want[(*key, *spread[int(hashlib.md5(f"42:7:{i}".encode()).hexdigest()[:8], 16) % n])] += 1
    got = {(r.judge_a, r.judge_b, r.stage, r.a, r.b): r.cell_n for r in drawn.filter("replicate = 7").collect()}
    assert got == dict(want)


def test_more_votes_for_absence_never_lose_acceptance(spark):
    rows = [(f"{k}", "J", "j1", i, A if i < k else P) for k in range(6) for i in range(5)]
    rows += [(f"{k}", "J", "j2", i, S) for k in range(6) for i in range(5)]
    df = spark.createDataFrame(rows, "trace_id string, judge_model string, stage string, run_idx bigint, judgment string")
    got = {int(r.trace_id): r.accepted for r in judging.consensus(df).collect()}
    assert [got[k] for k in range(6)] == [False, False, False, False, True, True]
