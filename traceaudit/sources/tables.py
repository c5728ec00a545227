"""Run manifests, prompt stores, stored labels, result files, ledgers and published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceaudit.functions.text import basename
from traceaudit.sources.files import full_path
from traceaudit.sources.jsonarray import numbered, read_json_array

# Agents with a prompt file, and the violation types in use.
PROMPT_AGENTS = ("APIPlannerAgent", "APICodePlannerAgent", "ShortlisterAgent", "TaskDecompositionAgent",
                 "PlanControllerAgent", "FinalAnswerAgent")
ACTIVE_VIOLATIONS = ("V1", "V2", "V3a", "V3b", "V4", "V6", "V7", "V8", "V9", "V10", "V11")

RUN = T.StructType([T.StructField(n, T.StringType()) for n in (
    "run_id", "task_id", "agent", "violation_id", "violation_category", "violation_name", "hard_soft", "run_status",
    "log_path")] + [T.StructField("task_pass_percentage", T.DoubleType())])

LEDGER = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("judge_model", T.StringType()),
                       T.StructField("stage", T.StringType()), T.StructField("run_idx", T.LongType()),
                       T.StructField("raw", T.StringType()), T.StructField("judgment", T.StringType()),
                       T.StructField("confidence", T.DoubleType()), T.StructField("reasoning", T.StringType()),
                       T.StructField("evidence", T.StringType()), T.StructField("error", T.StringType())])

RESULT_LIST = T.ArrayType(T.StructType([
    T.StructField("judgment", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()), T.StructField("evidence", T.StringType())]))

STORED_LABEL = T.StructType([
    T.StructField("precheck_passed", T.BooleanType()), T.StructField("judge1_consensus", T.StringType()),
    T.StructField("judge2_consensus", T.StringType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("final_label", T.StringType()), T.StructField("rejection_reason", T.StringType()),
    T.StructField("judge1_results", RESULT_LIST), T.StructField("judge2_results", RESULT_LIST)])


def load_manifest(spark: SparkSession, path: str, skip_failed: bool = True, base: str | None = None, glob: str = "*.json") -> DataFrame:
    """Runs of JSON manifests: an object with ``runs`` or a bare list, read by many tasks; ``run_pos`` is the place in the file.

    A run without a log path gets the default one. With ``base``, the folder that
    the paths are relative to, ``log_path`` is the path under which the log readers
    know the log. Failed runs are left out unless ``skip_failed`` is off.
    """
    listed = numbered(read_json_array(spark, path, "runs", glob), "run_pos")
    rows = listed.select(F.col("run_pos").cast("int").alias("run_pos"), F.from_json("text", RUN).alias("run")).select("run_pos", "run.*")
    text = [f.name for f in RUN.fields if isinstance(f.dataType, T.StringType)]
    for name in text:
        rows = rows.withColumn(name, F.coalesce(name, F.lit("")))
    default = F.format_string("logs/task_%s_%s_%s.log", "task_id", "agent", "violation_id")
    rows = (rows.withColumn("log_path", F.coalesce(F.nullif("log_path", F.lit("")), default))
                .withColumn("task_pass_percentage", F.coalesce("task_pass_percentage", F.lit(0.0)))
                .withColumn("log_file", basename(F.col("log_path"))))
    if base is not None:
        root = F.lit(full_path(base).rstrip("/") + "/")
        rows = rows.withColumn("log_path", F.when(F.col("log_path").rlike("^(/|[a-z0-9]+:/)"), F.col("log_path")).otherwise(F.concat(root, "log_path")))
    return rows.filter(F.col("run_status") != "failed") if skip_failed else rows


def load_runs(manifest: DataFrame, texts: DataFrame, prompts: DataFrame) -> DataFrame:
    """Validation records: runs with the texts taken from their logs and the original prompt.

    ``texts`` holds ``log_path`` (or, where the paths are not known, ``log_file``),
    ``target_agent, modified_system_prompt, user_input, agent_response`` per run. Runs without a modified prompt are dropped; other
    missing texts become empty.
    """
    from traceaudit.operators.lookup import lookup_join
    from traceaudit.operators.selection import shared_key
    keyed = manifest.withColumnRenamed("agent", "target_agent").withColumnRenamed("hard_soft", "designed_hard_soft")
    key = shared_key(keyed, texts)
    found = texts.select(key, "target_agent", "modified_system_prompt", "user_input", "agent_response")
    full = keyed.join(found, [key, "target_agent"], "inner").filter(F.col("modified_system_prompt").isNotNull())
    originals = prompts.select(F.col("agent").alias("target_agent"), F.col("prompt").alias("original_system_prompt"))
    full = lookup_join(full, originals, ["target_agent"])
    return full.select(
        "run_id", "task_id", "violation_id", "violation_category", "violation_name", "designed_hard_soft", "target_agent",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("original_system_prompt", "modified_system_prompt", "user_input",
                                                      "agent_response")], "task_pass_percentage")


def active_runs(runs: DataFrame, active: Sequence[str] = ACTIVE_VIOLATIONS) -> DataFrame:
    """Runs with a violation type in use."""
    return runs.filter(F.col("violation_id").isin(*active))


def clean_runs(runs: DataFrame, active: Sequence[str] = ACTIVE_VIOLATIONS, strict: bool = False) -> DataFrame:
    """Runs without an active violation; ``strict`` keeps only those marked clean."""
    if strict:
        return runs.filter(F.col("violation_id") == "clean")
    return runs.filter(~F.coalesce(F.col("violation_id"), F.lit("")).isin(*active))


def load_prompts(spark: SparkSession, folder: str, agents: Sequence[str] = PROMPT_AGENTS) -> DataFrame:
    """Original prompts, one ``{agent}.md`` file each."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_replace(basename(F.col("_metadata.file_path")), r"\.md$", "")
    return files.select(name.alias("agent"), F.col("value").alias("prompt")).filter(F.col("agent").isin(*agents))


def load_stored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels from ``*_validation.json`` files under a folder; the newest file of a run wins.

    Files that are not JSON objects are skipped.
    """
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_validation.json")
             .text(folder, wholetext=True)
             .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")))
    run = F.regexp_replace(basename(F.col("path")), r"_validation\.json$", "")
    from traceaudit.functions.jsontext import is_object, strict_parse
    parsed = files.filter(is_object(strict_parse(F.col("value")))).select(
        run.alias("run_id"), "at", "path", F.from_json("value", STORED_LABEL, {"mode": "PERMISSIVE"}).alias("l"))
    newest = parsed.groupBy("run_id").agg(
        F.max_by("l", F.struct("at", "path")).alias("l"))
    return newest.select(
        "run_id", F.coalesce("l.precheck_passed", F.lit(False)).alias("precheck_passed"),
        F.coalesce("l.judge1_consensus", F.lit("n/a")).alias("judge1_consensus"),
        F.coalesce("l.judge2_consensus", F.lit("n/a")).alias("judge2_consensus"),
        F.coalesce("l.accepted", F.lit(False)).alias("accepted"), "l.final_label", "l.rejection_reason",
        F.coalesce("l.judge1_results", F.array().cast(RESULT_LIST)).alias("judge1_results"),
        F.coalesce("l.judge2_results", F.array().cast(RESULT_LIST)).alias("judge2_results"))


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV manifest with a header; all columns are text, a quote inside quotes is doubled."""
    return spark.read.option("header", "true").option("escape", '"').csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result rows with their place among all rows, ``row_no``, counted from 0.

    Files follow each other by their path, blocks of a file by their start, rows
    of a block as they stand.
    """
    rows = spark.read.option("header", "true").option("escape", '"').csv(path).select(
        "*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"))
    if "score" not in rows.columns:
        raise ValueError("results need a score column")
    out = rows.withColumn("score", F.col("score").try_cast("bigint"))
    if "exception" in rows.columns:
        out = out.withColumn("exception", F.col("exception").try_cast("boolean"))
    from traceaudit.operators.ranking import globally_ranked
    placed = globally_ranked(out, ["__path", "__block", "__seq"], "__row")
    return placed.withColumn("row_no", F.col("__row") - 1).drop("__path", "__block", "__seq", "__row")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Judgment ledger from JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append judgments to a JSON-lines ledger."""
    rows.write.mode("append").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """Published dataset as parquet, one folder per split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Published dataset; judge results are parsed from their JSON text."""
    rows = spark.read.parquet(path)
    for name in ("judge1_results", "judge2_results"):
        if name in rows.columns:
            rows = rows.withColumn(name, F.from_json(name, RESULT_LIST))
    return rows


def write_graph_batches(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as parquet by ``batch_id``; a rerun replaces only the batches it contains."""
    for name, df, place in (("nodes", nodes, "node_idx"), ("edges", edges, "dst_idx")):
        (df.repartition("batch_id", F.floor(F.col(place) / 65_536)).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}"))
