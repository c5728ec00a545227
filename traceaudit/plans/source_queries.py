"""Queries over the readers: files are written from the benchmark tables, by many tasks, and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.operators import labels, selection
from traceaudit.plans.registry import query
from traceaudit.plans.span_queries import CALLS, logs_of, write_pieces
from traceaudit.session import durable_dir
from traceaudit.sources import adapters as A
from traceaudit.sources import logsource as L
from traceaudit.sources import spans as S
from traceaudit.sources import tables as T
from traceaudit.sources.files import write_file


def _place(spark) -> str:
    return f"{durable_dir(spark)}/files-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, target: str) -> str:
    """Write each row (name, body) as one file below ``target``; a task that runs again replaces its files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                write_file(f"{target}/{name}", body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("name", "body").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
    return target


def _log(column: str = "log_path"):
    return F.regexp_extract(column, "log=([^/]+)", 1)


@query("span_log_filtered", f"""WITH {CALLS}
SELECT 'run' || trace_id AS log, 'span' || CAST(span_idx % 4 AS VARCHAR) AS name, agent, count(*) AS n
FROM call WHERE span_idx % 5 <> 0 AND agent = 'APIPlannerAgent' AND span_idx % 4 IN (1, 2, 3) GROUP BY ALL""")
def span_log_filtered(spark, folder):
    """Spans of one agent and some names, filtered and cut to four columns inside the log format."""
    rows = L.read_spans(spark, logs_of(spark, folder), "*.txt", ("log_path", "name", "agent"), 1 << 20)
    kept = rows.filter((F.col("agent") == "APIPlannerAgent") & F.col("name").isin("span1", "span2", "span3"))
    return kept.groupBy(_log().alias("log"), "name", "agent").agg(F.count(F.lit(1)).alias("n"))


_SPAN_ROWS = f"""WITH {CALLS}
SELECT 'run' || trace_id AS log, 'span' || CAST(span_idx % 4 AS VARCHAR) AS name, agent, md5(user_input || '|' || response) AS text_md5
FROM call WHERE span_idx % 5 <> 0"""


def _span_rows(rows: DataFrame) -> DataFrame:
    texts = [F.coalesce(selection.attr(k), F.lit("")) for k in (selection.USER, selection.COMPLETION)]
    return rows.select(_log().alias("log"), "name", "agent", F.md5(F.concat_ws("|", *texts)).alias("text_md5"))


@query("span_log_batch", _SPAN_ROWS)
def span_log_batch(spark, folder):
    """All columns of the log format, read as a batch."""
    return _span_rows(L.read_spans(spark, logs_of(spark, folder), "*.txt", split_bytes=1 << 20))


@query("span_log_stream", _SPAN_ROWS)
def span_log_stream(spark, folder):
    """The same rows from the log format read as a stream."""
    target = _place(spark)
    rows = _span_rows(L.stream_spans(spark, logs_of(spark, folder), "*.txt", split_bytes=1 << 20))
    (rows.writeStream.format("parquet").option("path", f"{target}/out").option("checkpointLocation", f"{target}/cp")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(rows.schema).parquet(f"{target}/out")


_RUNS = """
run AS (SELECT o_custkey % 40 AS part, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS task_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'APIPlannerAgent' WHEN 1 THEN 'CodeAgent "x"' ELSE 'PlanControllerAgent' END AS agent,
    CASE o_orderkey % 5 WHEN 0 THEN 'V5' WHEN 1 THEN 'V1' WHEN 2 THEN 'V3a' WHEN 3 THEN 'clean' ELSE 'V11' END AS violation_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 7 = 1 THEN NULL ELSE 'ok [' || o_orderkey || ',' END AS run_status,
    CASE WHEN o_orderkey % 4 > 0 THEN 'logs/' || o_orderkey || '.log' END AS log_path, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 100 / 4.0 END AS pct
  FROM orders)"""

_RUN_COLUMNS = """run_id, task_id, agent, violation_id, coalesce(run_status, '') AS run_status, coalesce(pct, 0.0)::DOUBLE AS task_pass_percentage,
  coalesce(log_path, 'logs/task_' || task_id || '_' || agent || '_' || violation_id || '.log') AS log_path"""


def _runs(spark, folder) -> DataFrame:
    o = A.table(spark, folder, "orders")
    key = F.col("o_orderkey")

    def pick(n, *names):
        return F.element_at(F.array(*[F.lit(x) for x in names]), (key % n + 1).cast("int"))

    return o.select(
        (F.col("o_custkey") % 40).alias("part"), key.alias("pos"), key.cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("task_id"),
        pick(3, "APIPlannerAgent", 'CodeAgent "x"', "PlanControllerAgent").alias("agent"), pick(5, "V5", "V1", "V3a", "clean", "V11").alias("violation_id"),
        F.when(key % 7 == 0, "failed").when(key % 7 > 1, F.concat(F.lit("ok ["), key, F.lit(","))).alias("run_status"),
        F.when(key % 4 > 0, F.concat(F.lit("logs/"), key, F.lit(".log"))).alias("log_path"),
        F.when(key % 6 > 0, key % 100 / 4.0).alias("task_pass_percentage"))


def _manifests(spark, folder) -> str:
    """Manifests of forty parts: JSON objects, every third one a bare list."""
    run = F.struct("run_id", "task_id", "agent", "violation_id", "run_status", "log_path", "task_pass_percentage")
    runs = _runs(spark, folder)
    bare = F.col("part") % 3 == 0
    head = F.struct(F.lit(-1).cast("bigint").alias("pos"), F.when(bare, "[").otherwise('{"made": [1, {"runs": [2]}], "runs": [').alias("value"))
    end = F.struct(F.lit((1 << 63) - 1).alias("pos"), F.when(bare, "]").otherwise('], "end": "]"}').alias("value"))
    name = F.format_string("part%s/manifest.json", "part").alias("name")
    around = runs.select("part").distinct().select(name, F.lit(False).alias("item"), F.inline(F.array(head, end)))
    items = runs.select(name, F.lit(True).alias("item"), F.col("pos").cast("bigint").alias("pos"), F.to_json(run).alias("value"))
    return write_pieces(items.unionByName(around), _place(spark), ",")


@query("manifest_runs", f"""WITH {_RUNS} SELECT {_RUN_COLUMNS},
  row_number() OVER (PARTITION BY part ORDER BY pos) - 1 AS run_pos FROM run QUALIFY coalesce(run_status, '') <> 'failed'""")
def manifest_runs(spark, folder):
    """Runs of JSON manifests, failed ones left out, with their places."""
    names = ["run_id", "task_id", "agent", "violation_id", "run_status", "task_pass_percentage", "log_path", "run_pos"]
    return T.load_manifest(spark, _manifests(spark, folder)).select(*names).withColumn("run_pos", F.col("run_pos").cast("bigint"))


@query("manifest_active", f"""WITH {_RUNS}, r AS (SELECT {_RUN_COLUMNS} FROM run WHERE coalesce(run_status, '') <> 'failed')
SELECT violation_id, violation_id IN ('V1', 'V2', 'V3a', 'V3b', 'V4', 'V6', 'V7', 'V8', 'V9', 'V10', 'V11') AS active, count(*) AS n FROM r GROUP BY ALL""")
def manifest_active(spark, folder):
    """Runs with a violation type in use, and the others."""
    runs = T.load_manifest(spark, _manifests(spark, folder))
    both = T.active_runs(runs).withColumn("active", F.lit(True)).unionByName(T.clean_runs(runs).withColumn("active", F.lit(False)))
    return both.groupBy("violation_id", "active").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_csv", f"""WITH {_RUNS} SELECT run_id, agent, run_status, log_path FROM run""")
def manifest_csv(spark, folder):
    """A manifest as CSV with quotes, commas and missing values."""
    target = _place(spark)
    _runs(spark, folder).select("run_id", "agent", "run_status", "log_path").write.option("header", "true").option("escape", '"').csv(target)
    return T.read_manifest_csv(spark, target)


@query("results_csv", """
WITH r AS (SELECT o_orderkey % 16 AS part, o_orderkey AS k FROM orders)
SELECT CAST(k AS VARCHAR) AS run_id, CASE WHEN k % 9 > 0 THEN k % 5 END AS score, CASE WHEN k % 11 > 0 THEN k % 2 = 0 END AS exception,
  row_number() OVER (ORDER BY CAST(part AS VARCHAR), k) - 1 AS row_no FROM r""")
def results_csv(spark, folder):
    """Result rows of sixteen files with their places, scores and flags that are no numbers or truth values left null."""
    k = F.col("o_orderkey")
    rows = A.table(spark, folder, "orders").select(
        (k % 16).alias("part"), k.alias("k"),
        F.concat_ws(",", k.cast("string"), F.when(k % 9 > 0, (k % 5).cast("string")).otherwise("none"),
                    F.when(k % 11 > 0, F.when(k % 2 == 0, "True").otherwise("False")).otherwise("?")).alias("line"))
    files = rows.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    target = write_files(files.select(F.format_string("p%s/results.csv", "part").alias("name"),
                                      F.concat(F.lit("run_id,score,exception\n"), "lines", F.lit("\n")).alias("body")), _place(spark))
    return T.read_results_csv(spark, f"{target}/*").select("run_id", "score", "exception", "row_no")


@query("step_logs", """
WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_idx FROM conversations WHERE conv_id % 3 > 0)
SELECT 'conv' || conv_id || '.log' AS log_file, step_idx, CASE turn % 3 WHEN 0 THEN 'PlanControllerAgent' WHEN 1 THEN 'APIPlannerAgent' ELSE 'X' END AS name,
  CASE WHEN turn % 4 = 3 THEN 0 ELSE 2 END AS prompts, CASE WHEN turn % 4 = 3 THEN md5('') ELSE md5(role || ':' || text || '|ai:done') END AS text_md5 FROM c""")
def step_logs(spark, folder):
    """Steps of the one-object logs; span logs in the same folder are told apart and passed over."""
    rows = _steps(spark, folder)
    shown = F.array_join(F.transform("prompts", lambda p: F.concat_ws(":", p["role"], p["value"])), "|")
    return rows.select("log_file", "step_idx", "name", F.size("prompts").alias("prompts"), F.md5(shown).alias("text_md5"))


def _steps(spark, folder) -> DataFrame:
    c = A.table(spark, folder, "conversations")
    agent = F.element_at(F.array(F.lit("PlanControllerAgent"), F.lit("APIPlannerAgent"), F.lit("X")), (F.col("turn") % 3 + 1).cast("int"))
    prompts = F.array(F.struct("role", F.col("text").alias("value")), F.struct(F.lit("ai").alias("role"), F.lit("done").alias("value")))
    step = F.struct(agent.alias("name"), F.when(F.col("turn") % 4 == 3, F.slice(prompts, 1, 0)).otherwise(prompts).alias("prompts"))
    logs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("step")))), lambda s: s["step"]).alias("steps"))
    body = F.when(F.col("conv_id") % 3 > 0, F.to_json(F.struct(F.lit("say \"steps\": [").alias("intent"), "steps"))).otherwise(
        F.concat(F.lit('{"name": "span", "attributes": {"steps": '), F.to_json("steps"), F.lit("}}\n")))
    return S.read_step_logs(spark, write_files(logs.select(F.format_string("conv%s.log", "conv_id").alias("name"), body.alias("body")), _place(spark)), split_bytes=1 << 12)


@query("select_step", """
WITH c AS (SELECT conv_id, turn, role, text, CASE turn % 3 WHEN 0 THEN 'PlanControllerAgent' WHEN 1 THEN 'APIPlannerAgent' ELSE 'X' END AS name FROM conversations WHERE conv_id % 3 > 0),
run AS (SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'X' WHEN 2 THEN 'APIPlannerAgent' ELSE 'Nobody' END AS target_agent FROM c),
opt AS (SELECT *, 0 AS pref, CASE target_agent WHEN 'clean' THEN 'APIPlannerAgent' ELSE target_agent END AS name FROM run
        UNION ALL SELECT *, 1 AS pref, 'PlanControllerAgent' AS name FROM run),
m AS (SELECT o.*, c.turn, c.role, c.text, count(*) OVER (PARTITION BY o.conv_id, pref) AS total FROM opt o JOIN c ON o.conv_id = c.conv_id AND o.name = c.name WHERE turn % 4 <> 3),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pref, turn DESC) = 1)
SELECT 'conv' || run.conv_id || '.log' AS log_file, run.target_agent, CASE WHEN b.conv_id IS NOT NULL THEN CASE WHEN role = 'system' THEN text ELSE '' END END AS system_prompt,
  CASE WHEN b.conv_id IS NOT NULL THEN CASE WHEN role = 'user' THEN text ELSE '' END END AS user_input,
  CASE WHEN b.conv_id IS NOT NULL THEN CASE WHEN role = 'assistant' THEN text ELSE 'done' END END AS agent_response, total AS total_agent_spans
FROM run LEFT JOIN best b ON run.conv_id = b.conv_id""")
def select_step(spark, folder):
    """Representative step of each one-object log, with texts by role; logs are matched by their path."""
    steps = _steps(spark, folder)
    number = F.regexp_extract("log_file", r"conv(\d+)", 1).cast("bigint")
    agents = F.array(F.lit("clean"), F.lit("X"), F.lit("APIPlannerAgent"), F.lit("Nobody"))
    runs = steps.select("log_path", "log_file").distinct().select("log_path", "log_file", F.element_at(agents, (number % 4 + 1).cast("int")).alias("target_agent"),
                                                                  F.lit("V1").alias("violation_id"))
    chosen = selection.select_step(steps, runs.drop("log_file"))
    return chosen.join(runs.select("log_path", "log_file"), "log_path").select(
        "log_file", "target_agent", "system_prompt", "user_input", "agent_response", "total_agent_spans")


@query("stored_labels", """
WITH l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT 'doc' || doc_id AS run_id, quality = 1 AS precheck_passed, CASE WHEN toxic = 1 THEN 'policy_absent' ELSE 'n/a' END AS judge1_consensus,
  quality = 1 AND toxic = 1 AS accepted, CASE WHEN toxic = 1 THEN 'hard' END AS final_label, (doc_id % 3)::INT AS votes FROM l WHERE doc_id % 7 > 0""")
def stored_labels(spark, folder):
    """Stored validation files, one of each run, broken ones passed over."""
    rows = A.table(spark, folder, "labels")
    votes = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, (F.col("doc_id") % 3).cast("int")),
                        lambda i: F.struct(F.lit("policy_absent").alias("judgment"), (i / 2).alias("confidence")))
    good = F.to_json(F.struct(F.when(F.col("quality") == 1, True).alias("precheck_passed"), F.when(F.col("toxic") == 1, "policy_absent").alias("judge1_consensus"),
                              ((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("accepted"), F.when(F.col("toxic") == 1, "hard").alias("final_label"),
                              votes.alias("judge1_results")))
    body = F.when(F.col("doc_id") % 7 > 0, good).otherwise("{broken")
    target = write_files(rows.select(F.format_string("a%s/doc%s_validation.json", F.col("doc_id") % 5, "doc_id").alias("name"), body.alias("body")), _place(spark))
    return T.load_stored_labels(spark, target).select("run_id", "precheck_passed", "judge1_consensus", "accepted", "final_label",
                                                      F.size("judge1_results").alias("votes"))


@query("prompt_files", """
SELECT CASE c_nationkey WHEN 0 THEN 'APIPlannerAgent' WHEN 1 THEN 'ShortlisterAgent' ELSE 'FinalAnswerAgent' END AS agent,
  md5(string_agg(c_name, chr(10) ORDER BY c_custkey)) AS prompt_md5 FROM customer WHERE c_nationkey < 3 GROUP BY 1""")
def prompt_files(spark, folder):
    """Prompt files of known agents; other files are passed over."""
    c = A.table(spark, folder, "customer").filter("c_nationkey < 5")
    names = F.array(*[F.lit(n) for n in ("APIPlannerAgent", "ShortlisterAgent", "FinalAnswerAgent", "Unknown", "notes")])
    files = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: r["c_name"]), "\n").alias("body"))
    target = write_files(files.select(F.concat(F.element_at(names, (F.col("c_nationkey") + 1).cast("int")), F.lit(".md")).alias("name"), "body"), _place(spark))
    return T.load_prompts(spark, target).select("agent", F.md5("prompt").alias("prompt_md5"))


@query("ledger_files", """
SELECT CAST(user_id AS VARCHAR) AS trace_id, 'J' || event_id % 3 AS judge_model, event_type AS judgment, event_id AS run_idx FROM events WHERE event_id % 10 > 0""")
def ledger_files(spark, folder):
    """A ledger written in two appends, with lines that are no JSON between them."""
    e = A.table(spark, folder, "events")
    target = _place(spark)
    rows = e.filter("event_id % 10 > 0").select(F.col("user_id").cast("string").alias("trace_id"), F.concat(F.lit("J"), (F.col("event_id") % 3).cast("string")).alias("judge_model"),
                                                F.col("event_type").alias("judgment"), F.col("event_id").alias("run_idx"))
    for half in (0, 1):
        T.append_ledger(rows.filter(F.col("run_idx") % 2 == half), target)
    e.filter("event_id % 10 = 0").select(F.concat(F.lit('{"trace_id": '), "event_type").alias("value")).write.mode("append").text(target)
    return T.read_ledger(spark, target).select("trace_id", "judge_model", "judgment", "run_idx")


@query("published_splits", """
SELECT CAST(doc_id AS VARCHAR) AS run_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'dev' ELSE 'test' END AS split,
  CASE WHEN doc_id % 4 > 0 THEN lang END AS verdict FROM documents""")
def published_splits(spark, folder):
    """A published dataset by split, its judge results parsed again."""
    d = A.table(spark, folder, "documents")
    part = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "dev").otherwise("test")
    result = F.when(F.col("doc_id") % 4 > 0, F.to_json(F.array(F.struct(F.col("lang").alias("judgment")))))
    target = _place(spark)
    T.write_splits(d.select(F.col("doc_id").cast("string").alias("run_id"), result.alias("judge1_results"), part.alias("split")), target)
    return T.read_splits(spark, target).select("run_id", "split", F.get("judge1_results", F.lit(0))["judgment"].alias("verdict"))


@query("label_files", """SELECT 'trace' || doc_id || '.log' AS log_filename, toxic AS label FROM labels""")
def label_files(spark, folder):
    """Labels written in the order of their trace numbers and read back."""
    target = _place(spark)
    labels.write_labels(A.table(spark, folder, "labels").select(F.format_string("trace%s.log", "doc_id").alias("log_filename"), F.col("toxic").cast("bigint").alias("label")), target)
    return labels.read_labels(spark, target)


@query("graph_batches", """
SELECT user_id % 4 AS batch_id, CASE WHEN user_id % 4 = 1 THEN 'again' ELSE 'first' END AS written, count(*) AS nodes FROM events GROUP BY ALL""")
def graph_batches(spark, folder):
    """Graph batches, one of which is written again and replaced."""
    e = A.table(spark, folder, "events")
    nodes = e.select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("node_idx"), (F.col("user_id") % 4).alias("batch_id"), F.lit("first").alias("written"))
    edges = nodes.select("trace_id", F.col("node_idx").alias("src_idx"), F.col("node_idx").alias("dst_idx"), "batch_id")
    target = _place(spark)
    T.write_graph_batches(nodes, edges, target)
    T.write_graph_batches(nodes.filter("batch_id = 1").withColumn("written", F.lit("again")), edges.filter("batch_id = 1"), target)
    back = spark.read.parquet(f"{target}/nodes")
    return back.groupBy(F.col("batch_id").cast("bigint").alias("batch_id"), "written").agg(F.count(F.lit(1)).alias("nodes"))


@query("log_report", """
SELECT count(DISTINCT user_id) AS found, count(DISTINCT user_id) FILTER (user_id % 3 > 0) AS processed,
  count(DISTINCT user_id) FILTER (user_id % 3 = 0) AS discarded, count(DISTINCT user_id) FILTER (user_id % 3 > 0)::DOUBLE / count(DISTINCT user_id) AS success_rate FROM events""")
def log_report(spark, folder):
    """Logs found and processed; all bear one file name and are told apart by their path."""
    users = A.table(spark, folder, "events").select("user_id").distinct()
    body = F.when(F.col("user_id") % 3 > 0, '{"name": "a", "attributes": {}}\n').otherwise("no span\n")
    target = write_files(users.select(F.format_string("u%s/task.log", "user_id").alias("name"), body.alias("body")), _place(spark))
    return S.ingest_report(S.list_logs(spark, target), S.ingest_spans(spark, target))


@query("list_attributes", """
SELECT 'doc' || doc_id AS name, lang AS first_of_list, '' AS first_of_none, CAST(doc_id AS VARCHAR) AS number, '["a","b"]' AS text FROM documents""")
def list_attributes(spark, folder):
    """Attributes that are lists stand for their first element, texts that look like lists for themselves."""
    d = A.table(spark, folder, "documents")
    held = F.to_json(F.struct(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.struct(
        F.array("lang", "source").alias("list"), F.array().cast("array<string>").alias("none"), F.col("doc_id").alias("number"), F.lit('["a","b"]').alias("text")).alias("attributes")))
    target = _place(spark)
    d.select(held.alias("value")).write.text(target)
    spans = S.ingest_spans(spark, target, "split", "*.txt")
    return spans.select("name", *[selection.attr(k).alias(n) for k, n in (("list", "first_of_list"), ("none", "first_of_none"), ("number", "number"), ("text", "text"))])


_INPUT = """CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text || '## variable_1' WHEN 2 THEN 'Variables History ' || text WHEN 3 THEN 'Variables History: No variables stored' || text
  WHEN 4 THEN 'Relevant variables from history' || text || '# Variables Summary' WHEN 5 THEN 'Relevant Variables from History # Variables Summary'
  WHEN 6 THEN 'Relevant variables from history' || text ELSE NULL END"""


@query("inputs_with_variables", f"""
WITH t AS (SELECT doc_id, {_INPUT} AS t FROM documents)
SELECT doc_id, coalesce(contains(t, '## variable_') OR (contains(t, 'Variables History') AND NOT contains(t, 'No variables stored'))
  OR ((contains(t, 'Relevant variables from history') OR contains(t, 'Relevant Variables from History')) AND contains(t, '# Variables Summary')), false) AS has_variables FROM t""")
def inputs_with_variables(spark, folder):
    """Which inputs carry variables of earlier steps, over all ways to say so."""
    d = A.table(spark, folder, "documents")
    return d.select("doc_id", selection.has_variables(F.expr(_INPUT)).alias("has_variables"))
