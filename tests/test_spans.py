"""Log reading, span selection and rendering on written files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from traceaudit.operators import selection
from traceaudit.sources import spans as S
from traceaudit.sources import tables as T

NODE = "traceloop.association.properties.langgraph_node"
PATH = "traceloop.entity.path"


def span(name, **attributes):
    return {"name": name, "attributes": {k.replace("__", "."): v for k, v in attributes.items()}}


def chat(agent, system="sys", user="usr", reply="rep", **more):
    return {"name": "ChatOpenAI.chat", "attributes": {
        PATH: f"{agent}.x", NODE: agent, "gen_ai.prompt.0.role": "system", "gen_ai.prompt.0.content": system,
        "gen_ai.prompt.1.role": "user", "gen_ai.prompt.1.content": user, "gen_ai.completion.0.content": reply, **more}}


def task(agent, outputs, name="RunnableLambda.task"):
    return {"name": name, "attributes": {PATH: f"{agent}.y", NODE: agent, "traceloop.entity.output": json.dumps({"outputs": outputs})}}


def write(folder, name, *spans):
    (folder / name).write_text("\n\n".join(s if isinstance(s, str) else json.dumps(s, indent=2) for s in spans) + "\n", encoding="utf-8")


def brute_split(text):
    out = []
    for part in re.split(r"\n(?=\{)", text):
        try:
            value = json.loads(part.strip())
        except ValueError:
            continue
        if isinstance(value, dict):
            out.append(value)
    return out


def brute_scan(text):
    out, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        if text[at] in " \t\n\r":
            at += 1
            continue
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict):
            out.append(value)
        at = end
    return out


PIECES = ['{"name": "a"}', '{"name": "b", "attributes": {"k": "v\\n{"}}', '{\n  "name": "c",\n  "attributes": {\n    "x": 1\n  }\n}', "garbage {",
          '[1, 2]', "3", '{"name": "d"} {"name": "e"}', '{"outer":\n{"name": "in"}\n}', '{"open": [', '{"name": "f"},', "tail ]}", '"text"', "",
          '{"list": [\n{"name": "g"}\n,{"name": "h"}]}', 'x {"name": "i"} y']


@pytest.mark.parametrize("seed", range(4))
def test_reading_equals_whole_file_parsing(spark, tmp_path, seed):
    """Both modes on random mixtures, with splits so small that one file is read by many tasks."""
    rng = random.Random(seed)
    texts = {}
    for n in range(3):
        text = "\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40)))
        texts[f"t{n}.log"] = text
        (tmp_path / f"t{n}.log").write_text(text, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for mode, brute in (("split", brute_split), ("scan", brute_scan)):
            got = {}
            for r in S.ingest_spans(spark, str(tmp_path), mode).collect():
                got.setdefault(r.log_file, {})[r.span_idx] = json.loads(r.span_json)
            for name, text in texts.items():
                want = brute(text)
                have = got.get(name, {})
                assert [have[i] for i in sorted(have)] == want, (mode, name)
                assert sorted(have) == list(range(len(want)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "bad.log").write_bytes(b'{"name": "x\xff", "name": "y\xff"}')
    write(tmp_path, "list.log", {"name": "l", "attributes": {"gen_ai.prompt.0.content": ["first", "second"], "n": 5}})
    rows = {r.log_file: r for r in S.ingest_spans(spark, str(tmp_path)).collect()}
    assert "empty.log" not in rows
    assert rows["bad.log"].name == "y�"
    assert rows["list.log"].attributes["n"] == "5"
    df = S.ingest_spans(spark, str(tmp_path)).filter("log_file = 'list.log'")
    assert df.select(S.first_text(selection.attr("gen_ai.prompt.0.content"))).first()[0] == "first"


def test_listing_and_report(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.list_logs(spark, str(tmp_path))
    write(tmp_path, "a.log", chat("A"))
    write(tmp_path, "b.log", "nothing")
    files = S.list_logs(spark, str(tmp_path))
    got = S.ingest_report(files, S.ingest_spans(spark, str(tmp_path))).first()
    assert (got.found, got.processed, got.discarded, got.success_rate) == (2, 1, 1, 0.5)


def test_select_last_span_rules(spark, tmp_path):
    pca, apa = "PlanControllerAgent", "APIPlannerAgent"
    write(tmp_path, "a.log", chat(pca, user="1"), chat(pca, user="2"), chat(apa, user="p1"), chat(apa, user="p2", reply="go Coder_Agent"), chat(apa, user="p3"))
    write(tmp_path, "b.log", chat("FinalAnswerAgent", user="f"), chat(pca, user="c"))
    runs = spark.createDataFrame([("a.log", pca, "V6"), ("a.log", pca, "V1"), ("a.log", apa, "V3b"), ("a.log", apa, "V1"),
                                  ("a.log", "Ghost", "V1"), ("b.log", "clean", "none")], "log_file string, target_agent string, violation_id string")
    got = {(r.target_agent, r.violation_id): r for r in selection.select_last_span(S.ingest_spans(spark, str(tmp_path)), runs).collect()}
    assert got[pca, "V6"].user_input == "1" and got[pca, "V6"].span_index == 0 and got[pca, "V6"].total_agent_spans == 2
    assert got[pca, "V1"].user_input == "2"
    assert got[apa, "V3b"].user_input == "p2"
    assert got[apa, "V1"].user_input == "p3"
    assert got["Ghost", "V1"].user_input is None
    assert got["clean", "none"].user_input == "c"


def test_select_informative_rules(spark, tmp_path):
    pca, apa, coder = "PlanControllerAgent", "APIPlannerAgent", "APICodePlannerAgent"
    write(tmp_path, "a.log",
          chat(pca, system="first", user="u0"), task(pca, {"subtasks_progress": ["completed"]}), chat(pca, user="u1 ## variable_1"),
          task(pca, '{"subtasks_progress": ["completed", "in-progress"]}'), task(pca, {"b": 1, "a": "é"}),
          chat(apa, user="q0"), task(apa, "plain text"), chat(apa, user="q1"), task(apa, {"action": "CoderAgent"}), task(apa, "ConcludeTask now"))
    write(tmp_path, "b.log", chat(coder, user="z"), {"name": f"{coder}.task", "attributes": {
        NODE: coder, "traceloop.entity.output": json.dumps({"outputs": {"update": {"k": [1]}}})}})
    write(tmp_path, "c.log", chat(coder, user="z"), task(coder, {"only": 1}))
    runs = spark.createDataFrame([("a.log", pca, "V6"), ("a.log", pca, "V10"), ("a.log", pca, "V1"), ("a.log", apa, "V7"), ("a.log", apa, "V5"),
                                  ("a.log", coder, "V7"), ("b.log", coder, "V1"), ("c.log", coder, "V7")], "log_file string, target_agent string, violation_id string")
    rows = selection.select_informative_span(S.ingest_spans(spark, str(tmp_path)), runs).collect()
    got = {(r.log_file, r.target_agent, r.violation_id): (r.modified_system_prompt, r.user_input, r.agent_response) for r in rows}
    assert got["a.log", pca, "V6"] == ("first", "u1 ## variable_1", '{"subtasks_progress": ["completed", "in-progress"]}')
    assert got["a.log", pca, "V10"][1] == "u1 ## variable_1"
    assert got["a.log", pca, "V1"] == ("first", "u0", '{"subtasks_progress": ["completed"]}')
    assert got["a.log", apa, "V7"] == ("sys", "q1", '{"action": "CoderAgent"}')
    assert got["a.log", apa, "V5"] == ("sys", "q0", "ConcludeTask now")
    assert got["a.log", coder, "V7"] == (None, None, None)
    assert got["b.log", coder, "V1"] == ("sys", "z", '{"k": [1]}')
    assert got["c.log", coder, "V7"] == ("sys", "z", '{"only": 1}')


def test_first_prompts(spark, tmp_path):
    write(tmp_path, "a.log", chat("ShortlisterAgent", system="s1"), chat("ShortlisterAgent", system="s2"))
    write(tmp_path, "b.log", chat("ShortlisterAgent", system="late"), chat("APIPlannerAgent", system="p"))
    logs = spark.createDataFrame([("a.log", 1), ("b.log", 2)], "log_file string, log_pos int")
    got = {r.agent: r.system_prompt for r in selection.first_prompt_per_agent(S.ingest_spans(spark, str(tmp_path)), logs).collect()}
    assert got == {"ShortlisterAgent": "s2", "APIPlannerAgent": "p"}


def test_step_logs(spark, tmp_path):
    log = {"intent": "i", "steps": [
        {"name": "PlanControllerAgent", "prompts": [{"role": "system", "value": "s"}, {"role": "user", "value": "u"}, {"role": "ai", "value": "r"}]},
        {"name": "APIPlannerAgent", "prompts": []},
        {"name": "X", "prompts": [{"role": "system", "value": "old"}, {"role": "system", "value": "new"}, {"role": "human", "value": "h"}, {"role": "assistant", "value": "b"}]}]}
    (tmp_path / "s.log").write_text(json.dumps(log))
    write(tmp_path, "o.log", chat("A"))
    runs = spark.createDataFrame([("s.log", "clean", "n"), ("s.log", "X", "V1"), ("s.log", "Y", "V1")], "log_file string, target_agent string, violation_id string")
    steps = S.read_step_logs(spark, str(tmp_path))
    assert {r.log_file for r in steps.collect()} == {"s.log"}
    got = {r.target_agent: (r.system_prompt, r.user_input, r.agent_response) for r in selection.select_step(steps, runs).collect()}
    assert got == {"clean": ("s", "u", "r"), "X": ("new", "h", "b"), "Y": ("s", "u", "r")}


def test_render_trace(spark, tmp_path):
    write(tmp_path, "a.log", chat("A", system="S" * 4000, reply=json.dumps({"outputs": {"k": 1}})), chat("B", user="", reply="x"), span("other"))
    write(tmp_path, "b.log", *[span(f"n{i}") for i in range(7)])
    got = {r.log_file: r.trace_text for r in selection.render_trace(S.ingest_spans(spark, str(tmp_path))).collect()}
    assert got["a.log"].startswith("\n\n" + "─" * 60 + "[LLM CALL — A.x]\nSYSTEM:\n" + "S" * 3000 + "\nUSER:\nusr\nRESPONSE:\n")
    assert got["a.log"].endswith("[LLM CALL — B.x]\nSYSTEM:\nsys\nRESPONSE:\nx")
    assert got["b.log"] == "\n\n" + "─" * 60 + "\n\n".join(json.dumps(span(f"n{i}"), indent=2) for i in range(5))
    cut = {r.log_file: r.trace_text for r in selection.render_trace(S.ingest_spans(spark, str(tmp_path)), 100).collect()}
    assert cut["a.log"] == got["a.log"][:100] + "\n\n[... TRACE TRUNCATED ...]"


def test_manifest_prompts_labels(spark, tmp_path):
    runs = [{"run_id": "r1", "task_id": "t", "agent": "A", "violation_id": "V1", "hard_soft": "soft", "log_path": "logs/x.log"},
            {"run_id": "r2", "task_id": "u", "agent": "B", "violation_id": "clean", "run_status": "failed"},
            {"run_id": "r3", "task_id": "v", "agent": "C", "violation_id": "V5", "task_pass_percentage": 40.5}]
    (tmp_path / "m.json").write_text(json.dumps({"runs": runs}, indent=1))
    (tmp_path / "bare.json").write_text(json.dumps(runs))
    got = {r.run_id: r for r in T.load_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert set(got) == {"r1", "r3"} and got["r3"].log_path == "logs/task_v_C_V5.log" and got["r1"].log_file == "x.log"
    assert T.load_manifest(spark, str(tmp_path / "bare.json"), skip_failed=False).count() == 3
    table = T.load_manifest(spark, str(tmp_path / "m.json"))
    assert [r.run_id for r in T.active_runs(table).collect()] == ["r1"]
    assert [r.run_id for r in T.clean_runs(table).collect()] == ["r3"]

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "APIPlannerAgent.md").write_text("line1\nline2")
    (tmp_path / "p" / "Other.md").write_text("no")
    assert [(r.agent, r.prompt) for r in T.load_prompts(spark, str(tmp_path / "p")).collect()] == [("APIPlannerAgent", "line1\nline2")]

    folder = tmp_path / "v" / "deep"
    folder.mkdir(parents=True)
    (tmp_path / "v" / "r1_validation.json").write_text(json.dumps({"accepted": False}))
    (folder / "r2_validation.json").write_text("{broken")
    import os
    os.utime(tmp_path / "v" / "r1_validation.json", (1_000_000, 1_000_000))
    (folder / "r1_validation.json").write_text(json.dumps({"accepted": True, "final_label": "hard", "judge1_results": [{"judgment": "x", "confidence": 0.5}]}))
    labels = T.load_stored_labels(spark, str(tmp_path / "v")).collect()
    assert len(labels) == 1 and labels[0].accepted and labels[0].judge1_consensus == "n/a"
    assert labels[0].judge1_results[0].confidence == 0.5 and labels[0].judge2_results == []


def test_ledger_and_splits(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "a.jsonl").write_text('{"trace_id": "t", "judge_model": "J", "stage": "j1", "run_idx": 0, "judgment": "x"}\n\nnot json\n{"trace_id": "u"}\n')
    rows = T.read_ledger(spark, str(path))
    from traceaudit.operators.judging import completed_calls
    assert [tuple(r) for r in completed_calls(rows).collect()] == [("t", "J", "j1", 0)]
    T.append_ledger(rows.filter("stage = 'j1'").withColumn("run_idx", F.lit(1).cast("bigint")), str(path))
    assert completed_calls(T.read_ledger(spark, str(path))).count() == 2
    data = spark.createDataFrame([("r1", '[{"judgment": "a"}]', "train"), ("r2", None, "test")], "run_id string, judge1_results string, split string")
    T.write_splits(data, str(tmp_path / "ds"))
    back = {r.run_id: r for r in T.read_splits(spark, str(tmp_path / "ds")).collect()}
    assert back["r1"].judge1_results[0].judgment == "a" and back["r1"].split == "train"


def test_graph_batches_replace_only_their_own(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "trace_id int, node_idx int, batch_id int")
    edges = spark.createDataFrame([(1, 0, 1, 0)], "trace_id int, src_idx int, dst_idx int, batch_id int")
    T.write_graph_batches(nodes, edges, str(tmp_path))
    T.write_graph_batches(nodes.filter("batch_id = 1").withColumn("node_idx", F.lit(9)), edges, str(tmp_path))
    got = {(r.trace_id, r.node_idx) for r in spark.read.parquet(f"{tmp_path}/nodes").collect()}
    assert got == {(1, 0), (2, 9)}
