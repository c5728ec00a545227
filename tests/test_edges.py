"""Cases at the edges: equal file names, list attributes, long and short vectors, hot and null keys, repeated ids."""

import json

import pytest
from pyspark.sql import functions as F

from traceaudit.operators import evaluate, graph, judging, labels, lookup, sampling, selection
from traceaudit.operators.lanes import lane_aggregate
from traceaudit.sources import spans as S
from traceaudit.sources import tables


def put(folder, name, *spans):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(s) for s in spans) + "\n")


def chat(agent, system="s", user="u", reply="r"):
    return {"name": "ChatOpenAI.chat", "attributes": {selection.NODE: agent, selection.SYSTEM_ROLE: "system", selection.SYSTEM: system,
                                                      selection.USER: user, selection.COMPLETION: reply}}


def test_equal_file_names_in_two_folders(spark, tmp_path):
    put(tmp_path / "one", "task_1.log", {"name": "a"}, {"name": "b"})
    put(tmp_path / "two", "task_1.log", {"name": "c"})
    rows = S.ingest_spans(spark, str(tmp_path)).collect()
    assert sorted((r.log_path.split("/")[-2], r.log_file, r.span_idx, r.name) for r in rows) == [
        ("one", "task_1.log", 0, "a"), ("one", "task_1.log", 1, "b"), ("two", "task_1.log", 0, "c")]


def test_runs_of_equal_file_names_keep_apart(spark, tmp_path):
    put(tmp_path / "one", "t.log", chat("X", system="first"))
    put(tmp_path / "two", "t.log", chat("X", system="second"))
    spans = S.ingest_spans(spark, str(tmp_path))
    runs = spans.select("log_path").distinct().withColumns({"target_agent": F.lit("X"), "violation_id": F.lit("V1")})
    got = selection.select_last_span(spans, runs, "log_path").collect()
    assert sorted((r.log_path.split("/")[-2], r.system_prompt) for r in got) == [("one", "first"), ("two", "second")]


def test_only_real_lists_are_unwrapped(spark, tmp_path):
    put(tmp_path, "a.log", {"name": "x", "attributes": {"k": '["x","y"]', "l": ["x", "y"], "e": [], "n": 3, "b": True}})
    (row,) = S.ingest_spans(spark, str(tmp_path)).collect()
    assert row.attributes == {"k": '["x","y"]', "l": "x", "e": "", "n": "3", "b": "true"}


@pytest.mark.parametrize("update, text", [(["a", "b"], '["a", "b"]'), ("hi", '"hi"'), (True, "true"), ({"k": "é"}, '{"k": "é"}'), ({}, None), ([], None),
                                          (0, None), ("", None)])
def test_updates_come_back_as_json(spark, update, text):
    own = {"name": "X.task", "attributes": {selection.NODE: "X", selection.OUTPUT: json.dumps({"outputs": {"update": update}})}}
    spans = spark.createDataFrame([("a", i, s["name"], s["attributes"]) for i, s in enumerate([chat("X"), own])],
                                  "log_file string, span_idx long, name string, attributes map<string,string>")
    runs = spark.createDataFrame([("a", "X", "V1")], "log_file string, target_agent string, violation_id string")
    assert selection.select_informative_span(spans, runs).first().agent_response == text


def test_wrapped_outputs_print_as_values(spark):
    reply = '{"outputs": {"b": 1, "a": true, "n": null}}'
    spans = spark.createDataFrame([("a", 0, selection.CHAT_SPAN, {selection.COMPLETION: reply})],
                                  "log_file string, span_idx long, name string, attributes map<string,string>")
    assert "RESPONSE:\n{'b': 1, 'a': True, 'n': None}" in selection.render_trace(spans).first().trace_text


def test_spread_of_large_numbers(spark):
    nodes = spark.createDataFrame([("t", "llm_call", [1e8, 1e8 + 1, 1e8 + 2]), ("u", "x", [1.0]), ("v", "x", [1e9]), ("v", "x", [1e9 + 2])],
                                  "trace_id string, node_type string, features array<double>")
    got = {r.trace_id: (r.feature_mean, r.feature_std) for r in graph.feature_summary(nodes).collect()}
    assert got["t"] == pytest.approx((1e8 + 1, 1.0)) and got["v"] == pytest.approx((1e9 + 1, 2 ** 0.5)) and got["u"][0] == 1.0


def test_repeated_task_ids_do_not_multiply_children(spark):
    rows = [("t", i, task, parent, [], None, None) for i, (task, parent) in enumerate([("p", None), ("p", None), ("c", "p"), (None, None), ("d", None)])]
    spans = spark.createDataFrame(rows, "trace_id string, span_idx long, task_id string, parent_id string, tags array<string>, start_time string, end_time string")
    nodes = graph.build_trace_graph(spans)
    assert nodes.count() == 5
    assert [(r.src_idx, r.dst_idx) for r in graph.edges_of(nodes).collect()] == [(1, 2)]


def test_result_rows_follow_their_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("score\n1\n")
    (tmp_path / "b.csv").write_text("score\n" + "0\n" * 50)
    rows = {r.row_no: r.score for r in tables.read_results_csv(spark, str(tmp_path)).collect()}
    assert sorted(rows) == list(range(51)) and rows[0] == 1 and sum(rows.values()) == 1


@pytest.mark.parametrize("width", [3, 70])
@pytest.mark.parametrize("off", [-1, 1])
def test_vectors_of_another_length_are_an_error(spark, width, off):
    good = spark.createDataFrame([(1, [1.0] * width), (1, None)], "k int, features array<double>")
    assert lane_aggregate(good, ["k"], "features", width, F.sum).first().features == [1.0] * width
    bad = spark.createDataFrame([(1, [1.0] * (width + off))], "k int, features array<double>")
    with pytest.raises(Exception, match="is wanted"):
        lane_aggregate(bad, ["k"], "features", width, F.sum).collect()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_null_and_repeated_keys(spark, how):
    fact = spark.createDataFrame([(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}", i) for i in range(300)], "k string, i int")
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4)], "k string, d int")
    key = lambda d: sorted(map(str, [(r.k, r.i, r.d) for r in d.collect()]))
    assert key(lookup.hot_cold_join(fact, dim, ["k"], how, share=10)) == key(fact.join(dim, "k", how))


def test_wide_rows_count_by_their_bytes(spark):
    dim = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert 50_000 < lookup.size_of(dim, 10) < 60_000


def test_class_codes_and_matrix(spark):
    rows = spark.createDataFrame([("b", "a"), ("a", "a"), ("é", "b"), (None, "a")], "y_true string, y_pred string")
    assert {r.y_true: r.code for r in labels.label_codes(rows, "y_true").collect()} == {"a": 0, "b": 1, "é": 2}
    cells = {(r.y_true, r.y_pred): r.n for r in evaluate.confusion_matrix(rows).collect()}
    assert len(cells) == 9 and cells["b", "a"] == 1 and cells["a", "é"] == 0
    assert evaluate.confusion_matrix(rows.limit(0)).count() == 0


def test_embedded_objects():
    assert judging._enclosed('a {"x": {"y": 1}} b {"z": 2} {"open": 1') == ['{"x": {"y": 1}}', '{"z": 2}']
    assert judging._enclosed("no braces") == [] and judging._enclosed("}{") == []


def test_scan_steps_over_values(spark, tmp_path):
    (tmp_path / "a.log").write_text('x 12 "a {\\"q\\": 1} b" {"a": 1}[{"b": 2}] {broken {"c": 3}')
    rows = S.ingest_spans(spark, str(tmp_path), "scan").collect()
    assert [r.span_json for r in sorted(rows, key=lambda r: r.span_idx)] == ['{"a": 1}', '{"c": 3}']


def test_controls_show_the_original_prompt(spark):
    clean = spark.createDataFrame([("r1", ""), ("r2", "own"), ("r3", None)], "run_id string, modified_system_prompt string")
    prompts = spark.createDataFrame([("A", "original")], "agent string, prompt string")
    out = sampling.assign_controls(clean, [("V1", "A"), ("V2", "B")], prompts=prompts).collect()
    assert sorted((r.target_agent, r.modified_system_prompt) for r in out) == [("A", "original"), ("A", "original"), ("A", "own")]


def test_prediction_replies(spark):
    raw = ['{"violation_type": " V6 ", "sub_agent": "CodeAgent"}', '{"violation_type": 6}', "[1]", "broken {", None, '{"sub_agent": "Nobody"}']
    rows = evaluate.read_predictions(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert [(r.pred_violation, r.pred_agent) for r in rows] == [("V6", "CodeAgent")] + [(None, None)] * 5


def test_validation_records(spark):
    manifest = spark.createDataFrame([("r1", "t1", "A", "V1", "c", "n", "hard", 0.5, "a.log"), ("r2", "t2", "A", "V1", "c", "n", "soft", 0.0, "b.log")],
                                     "run_id string, task_id string, agent string, violation_id string, violation_category string, violation_name string, "
                                     "hard_soft string, task_pass_percentage double, log_file string")
    texts = spark.createDataFrame([("a.log", "A", "changed", None, "answer"), ("b.log", "A", None, "u", "x")],
                                  "log_file string, target_agent string, modified_system_prompt string, user_input string, agent_response string")
    prompts = spark.createDataFrame([("A", "original")], "agent string, prompt string")
    (row,) = tables.load_runs(manifest, texts, prompts).collect()
    assert (row.run_id, row.original_system_prompt, row.modified_system_prompt, row.user_input, row.designed_hard_soft) == (
        "r1", "original", "changed", "", "hard")
