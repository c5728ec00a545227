"""Rewriting, sampling, labels, graphs and evaluation on small cases."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceaudit.operators import evaluate, graph, labels, rewrite, sampling
from traceaudit.operators.lanes import lane_aggregate

PROMPT = "You must check.\nKeep the SCOPE small.\nAlways cite.\n\nSecond block\nscope again\n \nThird İ block."


def rewritten(spark, text, *steps):
    rules = rewrite.rules_frame(spark, [("V1", "A", "PVC-1", "Some Loss", "soft", i, op, anchor, new, end, f"n{i}")
                                        for i, (op, anchor, new, end) in enumerate(steps)])
    prompts = spark.createDataFrame([(text, "V1", "A")], "system_prompt string, violation_id string, target_agent string")
    r = rewrite.rewrite_prompts(prompts, rules).first()
    return r.modified_prompt, r.change_info.removed_items


def test_rewrite_operations(spark):
    assert rewritten(spark, PROMPT, ("weaken", "must", "may", None))[0] == PROMPT.replace("must", "may", 1)
    assert rewritten(spark, PROMPT, ("weaken", "MUST", "may", None)) == (PROMPT, [])
    assert rewritten(spark, PROMPT, ("weaken", "check", r"a\1$b", None))[0] == PROMPT.replace("check", r"a\1$b", 1)
    assert rewritten(spark, "  a x b ", ("remove_exact", "x", None, None))[0] == "a  b"
    text, gone = rewritten(spark, PROMPT, ("remove_line", "scope", None, None))
    assert text == PROMPT.replace("Keep the SCOPE small.\n", "") and gone == ["Keep the SCOPE small."]
    text, gone = rewritten(spark, PROMPT, ("remove_lines", "scope||CITE", None, None))
    assert "cope" not in text.lower() and "cite" not in text and len(gone[0].split("\n")) == 3
    text, gone = rewritten(spark, PROMPT, ("remove_paragraph", "SECOND", None, None))
    assert text == "You must check.\nKeep the SCOPE small.\nAlways cite.\n\nThird İ block." and gone == ["Second block\nscope again"]
    text, _ = rewritten(spark, PROMPT, ("remove_block", "keep", None, "second"))
    assert text == "You must check.\nSecond block\nscope again\n \nThird İ block."
    text, _ = rewritten(spark, PROMPT, ("remove_block", "always", None, "never there"))
    assert text == "You must check.\nKeep the SCOPE small.\n"
    assert rewritten(spark, "a.b\\Eq", ("remove_block", ".b\\E", None, "zz"))[0] == "a"


def test_rules_apply_in_order(spark):
    text, gone = rewritten(spark, "one\ntwo", ("weaken", "one", "two!", None), ("remove_line", "two", None, None), ("remove_line", "none", None, None))
    assert text == "two" and gone == ["one", "two!"]


def test_unsupported_cell(spark):
    rules = rewrite.rules_frame(spark, [("V1", "A", "P", "N", "soft", 1, "weaken", "x", "y", None, "n")])
    prompts = spark.createDataFrame([("x", "V2", "A"), ("x", "V1", "A")], "system_prompt string, violation_id string, target_agent string")
    got = {r.violation_id: (r.modified_prompt, r.error) for r in rewrite.rewrite_prompts(prompts, rules).collect()}
    assert got == {"V2": ("x", "unsupported: V2/A"), "V1": ("y", None)}
    assert [tuple(r) for r in rewrite.check_cells(prompts, rules).collect()] == [("V2", "A")]


def test_precheck(spark):
    cases = [(1, "a\nb", "a\nc"), (2, "a", "a"), (3, "a", "a\nb"), (4, "a\nb", "b\na"), (5, "a\r\nb", "a\nb"), (6, "a\na\nb", "a\nb"), (7, "x y", "x")]
    df = spark.createDataFrame(cases, "id int, original_system_prompt string, modified_system_prompt string")
    got = {r.id: (r.status, r.details, r.lines_removed, r.lines_added) for r in rewrite.precheck_diff(df).collect()}
    assert got == {1: ("PASS", None, 1, 1), 2: ("REJECT", "identical", None, None), 3: ("REJECT", "nothing_removed", None, None),
                   4: ("REJECT", "nothing_removed", None, None), 5: ("REJECT", "nothing_removed", None, None),
                   6: ("REJECT", "nothing_removed", None, None), 7: ("PASS", None, 1, 1)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 40), min_size=1, max_size=4))
def test_split_covers_all_rows_once(spark, sizes):
    rows = [(f"s{k}", f"{k}-{i}") for k, n in enumerate(sizes) for i in range(n)]
    out = sampling.stratified_split(spark.createDataFrame(rows, "s string, id string"), ["s"], "id").collect()
    assert sorted(r.id for r in out) == sorted(i for _, i in rows)
    for k, n in enumerate(sizes):
        mine = [r.split for r in out if r.s == f"s{k}"]
        n_train, n_val = max(1, round(0.7 * n)), max(1, round(0.15 * n))
        if n - n_train - n_val < 0:
            n_val = max(0, n - n_train - 1)
        assert (mine.count("train"), mine.count("val")) == (n_train, n_val)


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("s"), "id")
    def run(d):
        return {r.id: r.split for r in sampling.stratified_split(d, ["s"], "id").collect()}
    assert run(df.repartition(1)) == run(df.repartition(9))


def test_balanced_sample_quotas(spark):
    shape = {"a": (20, 20), "b": (2, 20), "c": (20, 3), "d": (1, 1), "e": (0, 12)}
    rows = [(g, lab, f"{g}{lab}{i}") for g, (h, s) in shape.items() for lab, n in (("hard", h), ("soft", s), ("other", 3)) for i in range(n)]
    out = sampling.balanced_sample(spark.createDataFrame(rows, "g string, lab string, id string"), "g", "lab", "id").collect()
    got = {g: tuple(sum(r.g == g and r.lab == lab for r in out) for lab in ("hard", "soft")) for g in shape}
    assert got == {"a": (5, 5), "b": (2, 8), "c": (7, 3), "d": (1, 1), "e": (0, 10)}


def test_rejected_sample_totals(spark):
    rows = [("x", f"x{i}") for i in range(50)] + [("y", f"y{i}") for i in range(4)] + [(None, "n0")]
    out = sampling.rejected_sample(spark.createDataFrame(rows, "reason string, id string"), "reason", "id", 12).collect()
    got = {k: sum(r.reason == k for r in out) for k in ("x", "y", "unknown")}
    assert len(out) == len({r.id for r in out}) == 12 and got["y"] == 4 and got["unknown"] == 1


def test_first_stratum_wins(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("2",), ("3",)], "id string")
    got = {r.id: r.part for r in sampling.combine_strata([("a", a), ("b", b)], "id").collect()}
    assert got == {"1": "a", "2": "a", "3": "b"}


def test_controls_only_get_agents_with_prompts(spark):
    clean = spark.createDataFrame([(f"r{i}", "t") for i in range(20)], "run_id string, task_id string")
    prompts = spark.createDataFrame([("B", "pb"), ("C", "pc")], "agent string, prompt string")
    out = sampling.assign_controls(clean, [("V1", "A"), ("V1", "B"), ("V2", "C")], prompts=prompts).collect()
    assert len(out) == 20 and {r.target_agent for r in out} == {"B", "C"}
    assert all(r.run_id.endswith(f"::ctrl::{r.violation_id}::{r.target_agent}") and r.original_system_prompt == "p" + r.target_agent.lower() for r in out)


def test_encode_labels_and_legacy_column(spark):
    rows = [("logs/a.log", "Z", "V2"), ("/x/b.log", "A", "V10"), ("  ", "B", "V1"), (None, "C", "V1")]
    out = labels.encode_labels(spark.createDataFrame(rows, "log_path string, agent string, failure_id string")).collect()
    assert {(r.log_filename, r.agent_code, r.violation_code) for r in out} == {("a.log", 1, 1), ("b.log", 0, 0)}
    with pytest.raises(ValueError):
        labels.encode_labels(spark.createDataFrame([("a",)], "log_path string"))


def test_positional_labels(spark):
    files = spark.createDataFrame([(f"trace{n}.log",) for n in ("10", "01", "1", "2", "3")], "log_file string")
    results = spark.createDataFrame([(i, s) for i, s in enumerate([1, 0, 1, 7, 0, 1, 1])], "row_no int, score int")
    got = {r.log_filename: (r.label, r.csv_row) for r in labels.positional_labels(files, results).collect()}
    # Name order: trace01, trace1, trace10, trace2, trace3; trace01 and trace1 share a name and the later row stays.
    assert got == {"trace1.log": (0, 1), "trace10.log": (1, 2), "trace3.log": (0, 4)}


def test_csv_and_json_labels(spark, tmp_path):
    from traceaudit.sources import tables as T
    (tmp_path / "results.csv").write_text("score,task_id,exception\n1,a,False\n0,b,True\n1,c,True\n")
    rows = T.read_results_csv(spark, str(tmp_path / "results.csv"))
    assert [r.score for r in rows.orderBy("row_no").collect()] == [1, 0, 1]
    report = labels.label_report(rows).first()
    assert report.failures == 1 and report.exception_rate == pytest.approx(2 / 3) and report.exception_agreement == pytest.approx(2 / 3)
    labels.write_labels(spark.createDataFrame([("trace10.log", 1), ("trace2.log", 0)], "log_filename string, label bigint"), str(tmp_path / "l"))
    assert {(r.log_filename, r.label) for r in labels.read_labels(spark, str(tmp_path / "l")).collect()} == {("trace10.log", 1), ("trace2.log", 0)}


def test_attach_binary_and_missing(spark):
    graphs = spark.createDataFrame([("a",), ("b",)], "log_filename string")
    labs = spark.createDataFrame([("a", 1), ("z", 0)], "log_filename string, label int")
    assert [tuple(r) for r in labels.attach_labels(graphs, labs, "binary").collect()] == [("a", 1.0)]
    assert [r.log_filename for r in labels.labels_without_data(graphs, labs).collect()] == ["z"]


def spans(spark):
    rows = [("t", 0, "a", None, ["llm_call"], "2024-01-01T00:00:00Z", "2024-01-01T00:00:02.500000Z"),
            ("t", 5, "b", "a", ["LLM_CALL"], "2024-01-01T00:00:05", None), ("t", 7, "c", "ghost", [], "bad", "2024-01-01T00:00:00Z"),
            ("t", 9, "d", "d", ["tool_call"], "2024-01-01T00:00:03Z", "2024-01-01T00:00:01Z"), ("alone", 0, "a", None, [], None, None),
            ("u", 0, "a", "a", [], None, None), ("u", 1, "b", "a", [], None, None)]
    return spark.createDataFrame(rows, "trace_id string, span_idx int, task_id string, parent_id string, tags array<string>, start_time string, end_time string")


def test_trace_graph(spark):
    nodes = graph.build_trace_graph(spans(spark))
    got = {(r.trace_id, r.task_id): (r.node_idx, r.parent_idx, r.node_type, r.duration) for r in nodes.collect()}
    assert got["t", "a"] == (0, None, "llm_call", 2.5) and got["t", "b"] == (1, 0, "non_llm", None)
    assert got["t", "c"] == (2, None, "non_llm", None) and got["t", "d"] == (3, 3, "non_llm", -2.0)
    assert ("alone", "a") not in got
    quality = {r.trace_id: (r.nodes, r.edges, r.roots, r.warning) for r in graph.graph_quality(nodes).collect()}
    assert quality == {"t": (4, 2, 2, "multiple_roots"), "u": (2, 2, 0, "no_root")}
    kept = graph.build_trace_graph(spans(spark), where=F.col("task_id") != "a")
    assert {r.trace_id for r in kept.collect()} == {"t"}


@pytest.mark.parametrize("width", [3, 64, 150])
def test_wide_vectors(spark, width):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), rng.normal(size=width).tolist()) for _ in range(40)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    for number, check in ((F.sum, np.sum), (F.max, np.max), (F.avg, np.mean)):
        got = {r.k: r.features for r in lane_aggregate(df, ["k"], "v", width, number, [F.count("*").alias("n")]).collect()}
        for k, vector in got.items():
            assert np.allclose(vector, check([v for i, v in rows if i == k], axis=0))


def test_propagation_by_matrix(spark):
    rng = np.random.default_rng(1)
    n, d = 6, 4
    x = rng.normal(size=(n, d))
    pairs = [(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (2, 4), (3, 3)]     # a duplicate edge, a self loop, node 5 isolated
    nodes = spark.createDataFrame([(1, i, x[i].tolist()) for i in range(n)], "trace_id int, node_idx int, features array<double>")
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "trace_id int, src_idx int, dst_idx int")
    a = np.zeros((n, n))
    for s, t in pairs:
        a[t, s] += s != t
    a += np.eye(n)
    deg = a.sum(axis=1)
    want = (a / np.sqrt(deg)[:, None] / np.sqrt(deg)[None, :]) @ x
    got = {r.node_idx: r.features for r in graph.propagate(nodes, edges, d).collect()}
    assert all(np.allclose(got[i], want[i]) for i in range(n))
    sage = {r.node_idx: np.array(r.features) for r in graph.propagate(nodes, edges, d, "sage").collect()}
    mean = (x[1] + 2 * x[2]) / 3
    assert np.allclose(sage[4], mean / np.linalg.norm(mean)) and not sage[5].any() and not sage[0].any()


def test_attention_pooling(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 2.0], 0.0), (1, 1, [3.0, 0.0], 1.0)], "trace_id int, node_idx int, features array<double>, s double")
    w = np.exp([0.0, 1.0])
    want = (w[:, None] * np.array([[1, 2], [3, 0]])).sum(axis=0) / (w.sum() + 1e-8)
    assert np.allclose(graph.pool_graph(nodes, 2, score="s").first().features, want)


def test_macro_scores_by_hand(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", None), ("c", "a"), ("b", "d")]
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    got = evaluate.macro_metrics(df).first()
    f = {"a": 2 * 1 / (2 + 2), "b": 2 * 1 / (2 + 2), "c": 0.0, "d": 0.0}
    assert got.accuracy == pytest.approx(2 / 5) and got.f1 == pytest.approx(sum(f.values()) / 4) and got.n == 5
    cells = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 16 and cells["a", "b"] == 1 and cells["d", "d"] == 0


def fold(values, delta, patience):
    best, best_epoch, waited = 0.0, 0, 0
    for epoch, v in enumerate(values, 1):
        if v > best + delta:
            best, best_epoch, waited = v, epoch, 0
        else:
            waited += 1
        if waited >= patience:
            return best_epoch, epoch, True
    return best_epoch, len(values), False


@pytest.mark.parametrize("seed", range(3))
def test_early_stop_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    runs = {r: [round(rng.random() * 0.3 + i * rng.choice([0, 0.0004, 0.01]), 5) for i in range(rng.randint(1, 60))] for r in range(12)}
    df = spark.createDataFrame([(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run_id int, step int, m double")
    out = evaluate.early_stop(df, F.col("m"), patience=5, bucket_size=7).collect()
    assert {r.run_id: (r.best_epoch, r.last_epoch, r.stopped_early) for r in out} == {r: fold(vs, 0.001, 5) for r, vs in runs.items()}


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_baselines_learn_separable_classes(spark, kind):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(3)[i % 3] * 4 + rng.normal(size=3) * 0.3).tolist(), "xyz"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, features array<double>, label string")
    model, codes, fitted = evaluate.fit_baseline(df, "label", kind, width=3, hidden=(8,), max_iter=60)
    assert evaluate.macro_metrics(fitted, "label", "prediction_label").first().accuracy > 0.95
    again = evaluate.apply_baseline(model, codes, df.limit(10), "label")
    assert again.count() == 10
