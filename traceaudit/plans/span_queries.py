"""Queries over spans: graphs, selection, rendering, rewriting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.text import rounded
from traceaudit.operators import features, graph, rewrite, selection
from traceaudit.plans.registry import query
from traceaudit.session import durable_dir
from traceaudit.sources import adapters as A
from traceaudit.sources import spans as S
from traceaudit.sources.files import open_file

NODES = """
span AS (
  SELECT conv_id AS trace_id, turn AS span_idx, conv_id || ':' || turn AS task_id, role, text,
         CASE WHEN turn > 0 THEN conv_id || ':' || ((turn - 1) // 2) END AS parent_id,
         CASE WHEN turn % 4 <> 3 THEN CAST(length(text) % 50 AS DOUBLE) END AS duration FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY span_idx) - 1 AS node_idx,
             count(*) OVER (PARTITION BY trace_id) AS total FROM span),
node AS (
  SELECT a.*, b.node_idx AS parent_idx, CASE WHEN a.role = 'assistant' THEN 'llm_call' ELSE 'non_llm' END AS node_type
  FROM numbered a LEFT JOIN numbered b ON a.trace_id = b.trace_id AND a.parent_id = b.task_id WHERE a.total > 1)"""


def _nodes(spark, folder):
    return graph.build_trace_graph(A.conversation_spans(spark, folder))


@query("trace_graph_nodes", f"""WITH {NODES}
SELECT trace_id, node_idx, parent_idx, node_type, duration, task_id FROM node""")
def trace_graph_nodes(spark, folder):
    """Nodes of the conversation trees with type, parent index and duration."""
    return _nodes(spark, folder).select("trace_id", "node_idx", "parent_idx", "node_type", "duration", "task_id")


@query("trace_graph_edges", f"WITH {NODES} SELECT trace_id, parent_idx AS src_idx, node_idx AS dst_idx FROM node WHERE parent_idx IS NOT NULL")
def trace_graph_edges(spark, folder):
    """Parent-to-child edges."""
    return graph.edges_of(_nodes(spark, folder))


@query("graph_quality", f"""WITH {NODES}
SELECT trace_id, count(*) AS nodes, count(*) FILTER (node_type = 'llm_call') AS llm_nodes,
  count(*) FILTER (node_type = 'non_llm') AS other_nodes, count(parent_idx) AS edges,
  count(*) FILTER (parent_idx IS NULL) AS roots,
  CASE count(*) FILTER (parent_idx IS NULL) WHEN 0 THEN 'no_root' WHEN 1 THEN NULL ELSE 'multiple_roots' END AS warning
FROM node GROUP BY trace_id""")
def graph_quality(spark, folder):
    """Node, edge and root counts per trace."""
    return graph.graph_quality(_nodes(spark, folder))


@query("common_features", f"""WITH {NODES}
SELECT trace_id, node_idx, role AS name_suffix, coalesce(duration, -1.0) AS duration_feature,
  CASE WHEN node_type = 'llm_call' THEN 0 ELSE 1 END AS node_type_id, 2 AS hierarchy_depth, CAST(span_idx AS INT) AS sibling_index,
  0 AS parent_index, CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_llm_call,
  CASE WHEN role = 'assistant' THEN 0.0 ELSE 1.0 END::DOUBLE AS is_tool_call,
  CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_complex FROM node""")
def common_features(spark, folder):
    """Duration, hierarchy and flag features of every node."""
    return features.common_features(_nodes(spark, folder), "drop_trace").select(
        "trace_id", "node_idx", "name_suffix", "duration_feature", "node_type_id", "hierarchy_depth", "sibling_index",
        "parent_index", "is_llm_call", "is_tool_call", "is_complex")


AGENT = "CASE {0} WHEN 0 THEN 'PlanControllerAgent' WHEN 1 THEN 'APIPlannerAgent' WHEN 2 THEN 'APICodePlannerAgent' ELSE 'FinalAnswerAgent' END"

CALLS = f"""
ev AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
call AS (
  SELECT user_id AS trace_id, event_id AS span_idx, event_type, {AGENT.format('(event_id // 2) % 4')} AS agent,
    CASE event_id % 4 WHEN 0 THEN 'Always return JSON with the plan.' WHEN 1 THEN 'Write Python code for the step.'
                      WHEN 2 THEN 'Answer briefly.' ELSE '' END AS system_prompt,
    CASE event_id % 3 WHEN 0 THEN '{{"intent": "buy ' || k || '", "goal": "save"}}' WHEN 1 THEN 'plain   text ' || chr(10) || ' ' || k
         ELSE '```json' || chr(10) || '{{"query": "q ' || k || '"}}' || chr(10) || '```' END AS user_input,
    CASE event_type
      WHEN 'view' THEN '{{"action": "CoderAgent", "subtasks": ["a", "b"], "code": "x = ' || k || '", "meta": ' || props || '}}'
      WHEN 'click' THEN '{{"action": "ConcludeTask", "subtasks_progress": ["completed", "not-started", "completed"], "thoughts": "done ' || k || '"}}'
      WHEN 'purchase' THEN '{{"action": "ShortlisterAgent", "shortlisted_apis": [{{"name": "a", "relevance_score": 0.' || lpad(k, 3, '0')
           || '1}}, {{"name": "b", "score": 0.25}}], "relevant_apis": ["a", "b", "c"]}}'
      WHEN 'signup' THEN '```json' || chr(10) || '{{"result": "signed up", "k": ' || k || '}}' || chr(10) || '```'
      ELSE 'Request failed with error code ' || k END AS response,
    CAST(k AS BIGINT) AS num_input_tokens, event_id % 7 AS num_output_tokens
  FROM ev)"""

SPANS = CALLS + f""",
sp AS (SELECT 'run' || trace_id AS log_file, span_idx, span_idx % 3 = 2 AS is_task, agent, system_prompt, user_input, response, event_type FROM call),
run AS (SELECT DISTINCT 'run' || user_id AS log_file, user_id AS log_pos,
          CASE WHEN user_id % 5 = 4 THEN 'clean' ELSE {AGENT.format('user_id % 3')} END AS target_agent,
          CASE user_id % 4 WHEN 0 THEN 'V6' WHEN 1 THEN 'V3b' WHEN 2 THEN 'V7' ELSE 'V5' END AS violation_id FROM events)"""


@query("select_last_span", f"""WITH {SPANS},
opt AS (SELECT *, 0 AS pref, target_agent AS agent FROM run WHERE target_agent <> 'clean'
        UNION ALL SELECT run.*, p.pref, p.agent FROM run, (VALUES (0, 'APIPlannerAgent'), (1, 'PlanControllerAgent'), (2, 'FinalAnswerAgent'), (3, 'ChatAgent')) p(pref, agent)
        WHERE target_agent = 'clean'),
m AS (SELECT o.log_file, o.target_agent, o.violation_id, o.pref, sp.*  EXCLUDE (log_file),
        row_number() OVER (PARTITION BY o.log_file, o.pref ORDER BY span_idx) - 1 AS pos,
        count(*) OVER (PARTITION BY o.log_file, o.pref) AS total, response LIKE '%CoderAgent%' AS del
      FROM opt o JOIN sp ON o.log_file = sp.log_file AND o.agent = sp.agent WHERE NOT is_task AND system_prompt <> ''),
best AS (SELECT *, row_number() OVER (PARTITION BY log_file ORDER BY pref,
     CASE WHEN target_agent = 'PlanControllerAgent' AND violation_id = 'V6' THEN span_idx
          WHEN target_agent = 'APIPlannerAgent' AND violation_id = 'V3b' AND del THEN span_idx - 4611686018427387904 ELSE -span_idx END) AS rn FROM m)
SELECT run.log_file, run.target_agent, run.violation_id, system_prompt, user_input, response AS agent_response, pos AS span_index, total AS total_agent_spans
FROM run LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON run.log_file = b.log_file""")
def select_last_span(spark, folder):
    """Representative call per run."""
    return selection.select_last_span(A.span_rows(spark, folder), A.runs(spark, folder))


@query("select_informative_span", f"""WITH {SPANS},
mine AS (SELECT r.target_agent, r.violation_id, sp.* FROM sp JOIN run r ON sp.log_file = r.log_file AND sp.agent = r.target_agent),
chat AS (SELECT *, row_number() OVER (PARTITION BY log_file ORDER BY span_idx) AS pos FROM mine WHERE NOT is_task AND system_prompt <> ''),
task AS (SELECT *, row_number() OVER (PARTITION BY log_file ORDER BY span_idx) AS pos FROM mine WHERE is_task AND event_type IN ('view', 'click', 'purchase')),
pair AS (SELECT t.log_file, t.target_agent, t.violation_id, t.pos, t.response, coalesce(c.user_input, f.user_input) AS user_input
         FROM task t JOIN chat f ON t.log_file = f.log_file AND f.pos = 1 LEFT JOIN chat c ON t.log_file = c.log_file AND t.pos = c.pos),
best AS (SELECT *, row_number() OVER (PARTITION BY log_file ORDER BY
    CASE WHEN target_agent = 'PlanControllerAgent' AND violation_id = 'V6' AND response LIKE '%not-started%' THEN 0
         WHEN target_agent = 'APIPlannerAgent' AND violation_id IN ('V3b', 'V7', 'V9', 'V1') AND response LIKE '%CoderAgent%' THEN 0
         WHEN target_agent = 'APIPlannerAgent' AND violation_id IN ('V5', 'V6') AND response LIKE '%ConcludeTask%' THEN 0 ELSE 1 END, pos) AS rn FROM pair)
SELECT run.log_file, run.target_agent, run.violation_id, c.system_prompt AS modified_system_prompt, b.user_input, b.response AS agent_response
FROM run LEFT JOIN (SELECT * FROM chat WHERE pos = 1) c ON run.log_file = c.log_file LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON run.log_file = b.log_file""")
def select_informative_span(spark, folder):
    """Prompt, input and response of the most informative iteration per run."""
    return selection.select_informative_span(A.span_rows(spark, folder), A.runs(spark, folder))


@query("first_prompt_per_agent", f"""WITH {SPANS},
c AS (SELECT sp.*, run.log_pos FROM sp JOIN run USING (log_file) WHERE NOT is_task AND system_prompt <> '' AND agent <> 'FinalAnswerAgent'),
r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY log_pos, span_idx DESC) AS rn FROM c)
SELECT agent, system_prompt, log_file FROM r WHERE rn = 1""")
def first_prompt_per_agent(spark, folder):
    """Original prompt of every agent from the first log that has it."""
    return selection.first_prompt_per_agent(A.span_rows(spark, folder), A.runs(spark, folder).select("log_file", "log_pos"))


@query("render_trace", f"""WITH {SPANS},
block AS (SELECT log_file, span_idx, '[LLM CALL — ' || agent || '.x]'
    || CASE WHEN system_prompt <> '' THEN chr(10) || 'SYSTEM:' || chr(10) || system_prompt ELSE '' END
    || chr(10) || 'USER:' || chr(10) || user_input || chr(10) || 'RESPONSE:' || chr(10) || response AS b FROM sp WHERE NOT is_task),
t AS (SELECT log_file, chr(10) || chr(10) || repeat('─', 60) || string_agg(b, chr(10) || chr(10) ORDER BY span_idx) AS txt FROM block GROUP BY log_file)
SELECT log_file, length(txt) > 60000 AS was_cut, md5(CASE WHEN length(txt) > 60000 THEN substr(txt, 1, 60000) || chr(10) || chr(10) || '[... TRACE TRUNCATED ...]' ELSE txt END) AS text_md5 FROM t""")
def render_trace(spark, folder):
    """Readable text per trace, as md5."""
    out = selection.render_trace(A.span_rows(spark, folder))
    return out.select("log_file", F.col("trace_text").endswith("[... TRACE TRUNCATED ...]").alias("was_cut"),
                      F.md5("trace_text").alias("text_md5"))


@query("precheck_diff", r"""
WITH d AS (SELECT doc_id, lang AS target_agent, text AS o, CASE doc_id % 3 WHEN 0 THEN 'Optionally: ' || text
             WHEN 1 THEN regexp_replace(text, '^[^\n]*\n', '') ELSE text END AS m FROM documents),
s AS (SELECT *, string_split_regex(o, '\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a,
             string_split_regex(m, '\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS b FROM d),
l AS (SELECT *, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS la, CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END AS lb FROM s),
x AS (SELECT *, list_sort(list_distinct(list_filter(la, lambda v: NOT list_contains(lb, v)))) AS gone,
             list_sort(list_distinct(list_filter(lb, lambda v: NOT list_contains(la, v)))) AS fresh FROM l)
SELECT doc_id, target_agent, CASE WHEN o <> m AND len(gone) > 0 THEN 'PASS' ELSE 'REJECT' END AS status,
  CASE WHEN o <> m AND len(gone) > 0 THEN NULL ELSE 'injection_failed_no_diff' END AS reason,
  CASE WHEN o = m THEN 'identical' WHEN len(gone) = 0 THEN 'nothing_removed' END AS details,
  CASE WHEN o <> m AND len(gone) > 0 THEN len(gone) END AS lines_removed, CASE WHEN o <> m AND len(gone) > 0 THEN len(fresh) END AS lines_added,
  CASE WHEN o <> m AND len(gone) > 0 THEN array_to_string(gone[1:10], '|') END AS removed_sample,
  CASE WHEN o <> m AND len(gone) > 0 THEN array_to_string(fresh[1:10], '|') END AS added_sample
FROM x""")
def precheck_diff(spark, folder):
    """Line differences between original and modified prompts."""
    out = rewrite.precheck_diff(A.prompt_pairs(spark, folder))
    return out.withColumns({c: F.array_join(c, "|") for c in ("removed_sample", "added_sample")})


RULES = [
    ("V1", "en", "PVC-1", "Scope Loss", "soft", 1, "weaken", ". ", "; ", None, "softened the first stop"),
    ("V1", "en", "PVC-1", "Scope Loss", "soft", 2, "remove_line", "ING", None, None, "dropped a line"),
    ("V1", "fr", "PVC-1", "Scope Loss", "soft", 1, "remove_exact", "le ", None, None, "dropped a word"),
    ("V1", "fr", "PVC-1", "Scope Loss", "soft", 2, "remove_lines", "ouche||ETTE", None, None, "dropped lines"),
    ("V1", "de", "PVC-1", "Scope Loss", "soft", 1, "remove_block", "en ", None, "er", "dropped a block"),
    ("V1", "de", "PVC-1", "Scope Loss", "soft", 2, "remove_paragraph", "zzzz", None, None, "nothing to drop"),
]


def _nth(pattern: str) -> str:
    return f"list_position(list_transform(string_split(t, chr(10)), lambda l: contains(lower(l), '{pattern}')), true)"


@query("rewrite_prompts", f"""
WITH p AS (SELECT doc_id, lang, text AS t FROM documents),
one AS (SELECT doc_id, lang, CASE
    WHEN lang = 'en' AND instr(t, '. ') > 0 THEN substr(t, 1, instr(t, '. ') - 1) || '; ' || substr(t, instr(t, '. ') + 2)
    WHEN lang = 'fr' AND instr(t, 'le ') > 0 THEN regexp_replace(regexp_replace(substr(t, 1, instr(t, 'le ') - 1) || substr(t, instr(t, 'le ') + 3), '^\\s+', ''), '\\s+$', '')
    WHEN lang = 'de' AND instr(lower(t), 'en ') > 0 THEN substr(t, 1, instr(lower(t), 'en ') - 1)
       || CASE WHEN instr(lower(substr(t, instr(lower(t), 'en ') + 3)), 'er') > 0
          THEN substr(substr(t, instr(lower(t), 'en ') + 3), instr(lower(substr(t, instr(lower(t), 'en ') + 3)), 'er')) ELSE '' END
    ELSE t END AS t,
  CASE WHEN lang = 'en' THEN (instr(t, '. ') > 0)::INT WHEN lang = 'fr' THEN (instr(t, 'le ') > 0)::INT
       WHEN lang = 'de' THEN (instr(lower(t), 'en ') > 0)::INT ELSE 0 END AS hits FROM p),
two AS (SELECT doc_id, lang, CASE
    WHEN lang = 'en' AND {_nth('ing')} > 0 THEN array_to_string(list_filter(string_split(t, chr(10)), lambda l, i: i <> {_nth('ing')}), chr(10))
    WHEN lang = 'fr' THEN array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT (contains(lower(l), 'ouche') OR contains(lower(l), 'ette'))), chr(10))
    WHEN lang = 'de' THEN regexp_replace(t, '\\n\\s*\\n', chr(10) || chr(10), 'g')
    ELSE t END AS t,
  hits + CASE WHEN lang = 'en' THEN coalesce(({_nth('ing')} > 0)::INT, 0)
       WHEN lang = 'fr' THEN (len(list_filter(string_split(t, chr(10)), lambda l: contains(lower(l), 'ouche') OR contains(lower(l), 'ette'))) > 0)::INT ELSE 0 END AS hits FROM one)
SELECT doc_id, md5(t) AS prompt_md5, CASE WHEN lang IN ('en', 'fr', 'de') THEN 'scope_loss' END AS type,
  CASE WHEN lang IN ('en', 'fr', 'de') THEN CAST(hits AS BIGINT) END AS edits, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unsupported: V1/' || lang END AS error
FROM two""")
def rewrite_prompts(spark, folder):
    """Documents rewritten by the rules of their language; languages without rules are errors."""
    prompts = A.table(spark, folder, "documents", spread=True).select(
        "doc_id", F.lit("V1").alias("violation_id"), F.col("lang").alias("target_agent"), F.col("text").alias("system_prompt"))
    out = rewrite.rewrite_prompts(prompts, rewrite.rules_frame(spark, RULES))
    return out.select("doc_id", F.md5("modified_prompt").alias("prompt_md5"), F.col("change_info.type").alias("type"),
                      F.size("change_info.removed_items").cast("bigint").alias("edits"), "error")


@query("check_cells", """SELECT DISTINCT 'V1' AS violation_id, lang AS target_agent FROM documents WHERE lang NOT IN ('en', 'fr', 'de')""")
def check_cells(spark, folder):
    """Requested cells without rules."""
    asked = A.table(spark, folder, "documents").select(F.lit("V1").alias("violation_id"), F.col("lang").alias("target_agent"))
    return rewrite.check_cells(asked, rewrite.rules_frame(spark, RULES))


def write_logs(spark, folder, target: str) -> None:
    """Write the benchmark calls as span logs, one file per user in span order, with some text that is not JSON between them."""
    c = A.chat_rows(spark, folder)
    body = F.to_json(F.struct(
        F.concat(F.lit("span"), (F.col("span_idx") % 4).cast("string")).alias("name"),
        F.struct(F.col("agent").alias("traceloop.association.properties.langgraph_node"),
                 F.col("user_input").alias("gen_ai.prompt.1.content"), F.col("response").alias("gen_ai.completion.0.content")).alias("attributes")))
    noise = F.when(F.col("span_idx") % 5 == 0, F.concat(body, F.lit("\nnot json {\n"))).otherwise(F.concat(body, F.lit("\n")))
    write_pieces(_log_pieces(c, "run", F.concat(noise, F.lit("\n"))), target)


def _log_pieces(rows, kind: str, text):
    """Pieces of one log a trace, in span order, in a folder that bears the trace's name."""
    name = F.coalesce(F.concat(F.lit(kind), F.col("trace_id").cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return rows.select(F.concat(F.lit("log="), name, F.lit("/part-0.txt")).alias("name"), F.lit(True).alias("item"), F.col("span_idx").alias("pos"), text.alias("value"))


def write_pieces(rows: DataFrame, target: str, between: str = "") -> str:
    """Write pieces ``name, item, pos, value`` as files below ``target``: by ``pos``, ``between`` from one item to the next.

    A task holds one Arrow batch, never a file; one that runs again replaces its files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, follows = None, None, False
        for batch in batches:
            for here, item, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None or here != name:
                    if out is not None:
                        out.close()
                    name, out, follows = here, open_file(f"{target}/{here}"), False
                out.write(((between if item and follows else "") + (value or "")).encode())
                follows = item
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        if out is not None:
            out.close()

    (rows.repartition("name").sortWithinPartitions("name", "pos").select("name", "item", "value")
     .mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save())
    return target


_WRITTEN: dict[tuple[str, str], str] = {}


def logs_of(spark, folder) -> str:
    """The folder of these logs, written once for each session and input, so that timings are those of reading."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        target = f"{durable_dir(spark)}/logs-{uuid.uuid4().hex}"
        write_logs(spark, folder, target)
        _WRITTEN[key] = target
    return _WRITTEN[key]


def span_digests(spans):
    """Log, number, name and an md5 of the attributes of each span."""
    at = [F.coalesce(selection.attr(k), F.lit("")) for k in (selection.USER, selection.COMPLETION, selection.NODE)]
    return spans.select(F.regexp_extract("log_path", "log=([^/]+)", 1).alias("log"), F.col("span_idx").cast("bigint"), "name",
                        F.md5(F.concat_ws("|", *at)).alias("text_md5"))


def _digest_sql(where: str) -> str:
    return f"""WITH {CALLS}
SELECT 'run' || trace_id AS log, row_number() OVER (PARTITION BY trace_id ORDER BY span_idx) - 1 AS span_idx, 'span' || CAST(span_idx % 4 AS VARCHAR) AS name,
  md5(user_input || '|' || response || '|' || agent) AS text_md5 FROM call WHERE {where}"""


@query("ingest_spans_scan", _digest_sql("true"))
def ingest_spans_scan(spark, folder):
    """Logs written from the calls, read back with recovery of objects between other text."""
    return span_digests(S.ingest_spans(spark, logs_of(spark, folder), "scan", "*.txt"))


@query("ingest_spans", _digest_sql("span_idx % 5 <> 0"))
def ingest_spans(spark, folder):
    """Logs written from the calls, read back with strict pieces only."""
    return span_digests(S.ingest_spans(spark, logs_of(spark, folder), "split", "*.txt"))


@query("ingest_trace_graph", f"""WITH {NODES}
SELECT 'conv' || trace_id AS trace_id, count(*) AS nodes, count(*) FILTER (node_type = 'llm_call') AS llm_nodes,
  count(*) FILTER (node_type = 'non_llm') AS other_nodes, count(parent_idx) AS edges, count(*) FILTER (parent_idx IS NULL) AS roots,
  CASE count(*) FILTER (parent_idx IS NULL) WHEN 0 THEN 'no_root' WHEN 1 THEN NULL ELSE 'multiple_roots' END AS warning
FROM node GROUP BY trace_id""")
def ingest_trace_graph(spark, folder):
    """From log files to graphs: conversations written as logs, read, rebuilt as trees and counted."""
    target = f"{durable_dir(spark)}/logs-{uuid.uuid4().hex}"
    c = A.conversation_spans(spark, folder)
    body = F.to_json(F.struct("name", "task_id", "parent_id", "tags", "start_time", "end_time", F.struct(F.col("text").alias("text")).alias("input")))
    write_pieces(_log_pieces(c, "conv", F.concat(body, F.lit("\n"))), target)
    spans = S.ingest_spans(spark, target, "split", "*.txt")
    tasks = S.task_rows(spans, F.regexp_extract("log_path", "log=([^/]+)", 1))
    return graph.graph_quality(graph.build_trace_graph(tasks))
