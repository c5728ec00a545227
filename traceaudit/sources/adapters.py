"""Views of the 14 benchmark tables as spans, judgments, prompts, predictions and graphs.

The benchmark has no span logs, so these projections derive them row by row
with plain expressions that any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGES = ["J0", "J1", "J2"]


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A benchmark table; ``spread`` shares a small file among all cores before heavy row work."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_small(rows) if spread else rows


def spread_small(rows: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Share a table of at most ``most_bytes`` on disk among the cores; larger ones have splits enough and are never shuffled for it."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else rows


def _by_type(column: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, value in mapping.items():
        out = (F if out is None else out).when(column == key, F.lit(value))
    return out


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Judgment ledger from events: the event id picks judge, stage and run."""
    return judgments_of(table(spark, folder, "events"))


def judgments_of(e: DataFrame) -> DataFrame:
    """The ledger columns of event rows, batch or streaming."""
    kind, number = F.col("event_type"), F.col("event_id")
    first = _by_type(kind, {"view": "policy_absent", "click": "policy_absent", "signup": "policy_absent",
                            "purchase": "policy_present", "error": "ERROR"})
    second = _by_type(kind, {"view": "hard_violation", "click": "soft_violation", "purchase": "soft_violation",
                             "signup": "no_violation", "error": "PARSE_ERROR"})
    is_first = F.expr("(event_id div 3) % 2 = 0")
    return e.select(
        F.col("user_id").alias("trace_id"),
        F.concat(F.lit("J"), (number % 3).cast("string")).alias("judge_model"),
        F.when(is_first, "j1").otherwise("j2").alias("stage"),
        F.expr("event_id div 6").alias("run_idx"),
        F.when(is_first, first).otherwise(second).alias("judgment"),
        F.when(~is_first, F.concat(F.lit("why "), F.col("props"))).alias("reasoning"),
        F.concat(F.lit("seen "), kind).alias("evidence"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Raw judge replies from events in the shapes judges produce."""
    e = table(spark, folder, "events", spread=True)
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"judgment": "'), F.col("event_type"), F.lit('", "confidence": 0.'), F.lpad(k, 3, "0"),
                    F.lit(', "evidence": "item '), k, F.lit('"}'))
    shape = F.col("event_id") % 5
    raw = (F.when(shape == 0, body)
            .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(shape == 2, F.concat(F.lit("My verdict: "), body, F.lit(" as explained.")))
            .when(shape == 3, F.concat(F.lit('{"judgment": "'), F.col("event_type")))
            .otherwise(""))
    return e.select(F.col("event_id"), raw.alias("raw"))


def prompt_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Original and modified prompt per document: first line prefixed, first line dropped, or unchanged."""
    d = table(spark, folder, "documents", spread=True)
    way = F.col("doc_id") % 3
    changed = (F.when(way == 0, F.concat(F.lit("Optionally: "), F.col("text")))
                .when(way == 1, F.regexp_replace("text", r"^[^\n]*\n", ""))
                .otherwise(F.col("text")))
    return d.select("doc_id", F.col("lang").alias("target_agent"), F.col("text").alias("original_system_prompt"),
                    changed.alias("modified_system_prompt"))


def conversation_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Trace nodes from conversation turns; the parent of turn t is turn (t-1) div 2."""
    c = table(spark, folder, "conversations")
    trace, turn = F.col("conv_id").cast("string"), F.col("turn")
    parent = F.when(turn > 0, F.concat(trace, F.lit(":"), F.expr("(turn - 1) div 2").cast("string")))
    second = F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    start = F.timestamp_seconds(F.unix_timestamp(second) + turn * 60)
    end = F.when(turn % 4 != 3, F.timestamp_seconds(F.unix_timestamp(second) + turn * 60 + F.length("text") % 50))
    return c.select(
        F.col("conv_id").alias("trace_id"), turn.alias("span_idx"),
        F.concat(trace, F.lit(":"), turn.cast("string")).alias("task_id"), parent.alias("parent_id"),
        F.concat(F.lit("0."), turn.cast("string"), F.lit(":"), F.col("role")).alias("name"),
        F.when(F.col("role") == "assistant", F.array(F.lit("llm_call"), F.lit("Complex")))
         .otherwise(F.array(F.lit("tool_call"))).alias("tags"),
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"),
        F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end_time"),
        F.col("role"), F.col("text"))


def chat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One chat call per event with system prompt, user input, response and token counts.

    The responses are JSON objects, a fenced block or plain text, by event type.
    """
    e = table(spark, folder, "events", spread=True)
    k = F.get_json_object("props", "$.k")
    num = F.col("event_id")
    response = (
        F.when(F.col("event_type") == "view", F.concat(
            F.lit('{"action": "CoderAgent", "subtasks": ["a", "b"], "code": "x = '), k,
            F.lit('", "meta": '), F.col("props"), F.lit("}")))
        .when(F.col("event_type") == "click", F.concat(
            F.lit('{"action": "ConcludeTask", "subtasks_progress": ["completed", "not-started", "completed"], '
                  '"thoughts": "done '), k, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit('{"action": "ShortlisterAgent", "shortlisted_apis": [{"name": "a", "relevance_score": 0.'),
            F.lpad(k, 3, "0"), F.lit('1}, {"name": "b", "score": 0.25}], "relevant_apis": ["a", "b", "c"]}')))
        .when(F.col("event_type") == "signup", F.concat(
            F.lit('```json\n{"result": "signed up", "k": '), k, F.lit("}\n```")))
        .otherwise(F.concat(F.lit("Request failed with error code "), k)))
    system = (F.when(num % 4 == 0, "Always return JSON with the plan.")
               .when(num % 4 == 1, "Write Python code for the step.")
               .when(num % 4 == 2, "Answer briefly.").otherwise(""))
    user = (F.when(num % 3 == 0, F.concat(F.lit('{"intent": "buy '), k, F.lit('", "goal": "save"}')))
             .when(num % 3 == 1, F.concat(F.lit("plain   text \n "), k))
             .otherwise(F.concat(F.lit('```json\n{"query": "q '), k, F.lit('"}\n```'))))
    agent = _agent(F.expr("event_id div 2") % 4)
    return e.select(
        F.col("user_id").alias("trace_id"), num.alias("span_idx"), F.col("event_type"),
        agent.alias("agent"), system.alias("system_prompt"),
        user.alias("user_input"), response.alias("response"),
        (k.cast("bigint")).alias("num_input_tokens"), (num % 7).alias("num_output_tokens"))


def span_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Log spans with dotted attribute keys: two thirds chat spans, one third task spans."""
    c = chat_rows(spark, folder)
    is_task = F.col("span_idx") % 3 == 2
    wrapped = F.when(F.col("event_type").isin("view", "click", "purchase"),
                     F.concat(F.lit('{"outputs": '), F.col("response"), F.lit("}")))
    values = {
        "traceloop.entity.path": F.concat("agent", F.lit(".x")),
        "traceloop.association.properties.langgraph_node": F.col("agent"),
        "gen_ai.prompt.0.role": F.when(~is_task, F.lit("system")),
        "gen_ai.prompt.0.content": F.when(~is_task, F.col("system_prompt")),
        "gen_ai.prompt.1.content": F.when(~is_task, F.col("user_input")),
        "gen_ai.completion.0.content": F.when(~is_task, F.col("response")),
        "traceloop.entity.output": F.when(is_task, wrapped),
    }
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    attributes = F.map_from_entries(F.filter(F.array(*pairs), lambda kv: kv["value"].isNotNull()))
    return c.select(F.concat(F.lit("run"), F.col("trace_id").cast("string")).alias("log_file"), "span_idx",
                    F.when(is_task, "RunnableLambda.task").otherwise("ChatOpenAI.chat").alias("name"),
                    attributes.alias("attributes"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per user of the span rows; every fifth is a clean run."""
    u = table(spark, folder, "events").select("user_id").distinct()
    user = F.col("user_id")
    violation = (F.when(user % 4 == 0, "V6").when(user % 4 == 1, "V3b").when(user % 4 == 2, "V7").otherwise("V5"))
    return u.select(F.concat(F.lit("run"), user.cast("string")).alias("log_file"), user.alias("log_pos"),
                    F.when(user % 5 == 4, "clean").otherwise(_agent(user % 3)).alias("target_agent"),
                    violation.alias("violation_id"))


def _agent(number: Column) -> Column:
    return (F.when(number == 0, "PlanControllerAgent").when(number == 1, "APIPlannerAgent")
             .when(number == 2, "APICodePlannerAgent").otherwise("FinalAnswerAgent"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with labels: strata (lang, quality), hard/soft from toxic."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return d.join(table(spark, folder, "labels"), "doc_id")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """True and predicted class per vector; about a third of the predictions are moved on by one."""
    e = table(spark, folder, "embeddings")
    draw = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    wrong = (F.col("label") + 1) % 10
    return e.select(
        "vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("y_true"),
        F.when(draw < 5, F.lit(None)).when(draw < 35, F.concat(F.lit("c"), wrong.cast("string")))
         .otherwise(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("y_pred"),
        (F.lit(1000) + draw).alias("prompt_tokens"), (draw % 10).alias("completion_tokens"),
        (draw.cast("double") / 10).alias("latency_s"))


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Training history per user: events in id order, value as the metric."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), (F.col("value") / 500).alias("agent_f1"),
        (F.col("value") / 400).alias("violation_f1"))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as nodes of graphs of 50."""
    e = table(spark, folder, "embeddings")
    return e.select(F.expr("vec_id div 50").alias("trace_id"), (F.col("vec_id") % 50).alias("node_idx"),
                    F.col("embedding").alias("features"), F.col("label"))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Binary-tree edges inside every graph."""
    e = table(spark, folder, "embeddings").select("vec_id").filter(F.col("vec_id") % 50 > 0)
    return e.select(F.expr("vec_id div 50").alias("trace_id"), F.expr("(vec_id % 50 - 1) div 2").alias("src_idx"),
                    (F.col("vec_id") % 50).alias("dst_idx"))
