"""Labels: encoding, positional labels, attachment to traces and dataset statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.functions.text import basename, normal_trace_name, trace_number
from traceaudit.operators.lookup import lookup_join
from traceaudit.operators.ranking import globally_ranked


def label_codes(rows: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Label values numbered from 0 in sorted order, by a range sort of the distinct ones."""
    values = rows.filter(F.col(column).isNotNull()).select(column).distinct()
    return globally_ranked(values, [column], "__pos").select(column, (F.col("__pos") - 1).cast("bigint").alias(code))


def violation_column(rows: DataFrame) -> str:
    """Name of the violation column of a manifest: the current name, else the legacy one."""
    for name in ("violation_id", "failure_id"):
        if name in rows.columns:
            return name
    raise ValueError("manifest needs a violation_id or failure_id column")


def encode_labels(manifest: DataFrame) -> DataFrame:
    """Codes for agent and violation per log file; rows without a log path are skipped."""
    violation = violation_column(manifest)
    for name in ("log_path", "agent"):
        if name not in manifest.columns:
            raise ValueError(f"manifest needs column {name}")
    rows = manifest.filter(F.col("log_path").isNotNull() & (F.trim("log_path") != ""))
    coded = lookup_join(rows, label_codes(rows, "agent", "agent_code"), ["agent"])
    coded = lookup_join(coded, label_codes(rows, violation, "violation_code"), [violation])
    return coded.select(basename(F.col("log_path")).alias("log_filename"), F.col("agent"),
                        F.col(violation).alias("violation_id"), "agent_code", "violation_code")


def positional_labels(files: DataFrame, results: DataFrame, file_name: str = "log_file",
                      row_order: Sequence[str] = ("row_no",)) -> DataFrame:
    """Join the i-th result row with the i-th log file in name order.

    Stops at the shorter side, drops scores other than 0 and 1, normalises the
    file names and keeps the last row of a repeated name.
    """
    if "score" not in results.columns:
        raise ValueError("results need a score column")
    named = globally_ranked(files.select(F.col(file_name).alias("original_name")), ["original_name"], "__pos")
    scored = globally_ranked(results, list(row_order), "__pos")
    joined = named.join(scored, "__pos").filter(F.col("score").isin(0, 1))
    keep = [c for c in ("task_id", "exception") if c in results.columns]
    chosen = joined.groupBy(normal_trace_name(F.col("original_name")).alias("log_filename")).agg(
        F.max_by(F.struct("original_name", F.col("score").cast("bigint").alias("label"),
                          (F.col("__pos") - 1).alias("csv_row"), *keep), F.col("__pos")).alias("__row"))
    return chosen.select("log_filename", "__row.*")


def label_report(results: DataFrame) -> DataFrame:
    """Score counts, exception rate and agreement between exceptions and failures."""
    cells = [F.count_if(F.col("score") == 0).alias("failures"), F.count_if(F.col("score") == 1).alias("successes")]
    if "exception" in results.columns:
        bad = F.col("exception").cast("int")
        cells += [F.avg(bad).alias("exception_rate"),
                  F.avg((F.col("score") == 1 - bad).cast("int")).alias("exception_agreement")]
    return results.agg(*cells)


def unlabelled_files(files: DataFrame, labels: DataFrame, file_name: str = "log_file") -> DataFrame:
    """Log files whose normalised name has no label."""
    named = files.select(F.col(file_name), normal_trace_name(F.col(file_name)).alias("log_filename"))
    return named.join(labels.select("log_filename"), "log_filename", "left_anti")


def attach_labels(graphs: DataFrame, labels: DataFrame, mode: str = "multi_task") -> DataFrame:
    """Keep the graphs that have a label and add it.

    ``multi_task`` adds ``y_agent`` and ``y_violation`` (the legacy
    ``failure_code`` fills in for a missing ``violation_code``); ``binary`` adds ``y``.
    """
    if mode == "binary":
        return graphs.join(labels.select("log_filename", F.col("label").cast("double").alias("y")), "log_filename")
    violation = F.col("violation_code") if "violation_code" in labels.columns else F.lit(None).cast("bigint")
    if "failure_code" in labels.columns:
        violation = F.coalesce(violation, F.col("failure_code"))
    codes = labels.select("log_filename", F.col("agent_code").alias("y_agent"), violation.alias("y_violation"))
    return graphs.join(codes, "log_filename")


def labels_without_data(graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose log file has no graph."""
    return labels.join(graphs.select("log_filename"), "log_filename", "left_anti")


def class_distribution(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count and percentage per class or per (agent, violation) pair."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n").cast("double") * 100.0 / whole)


def trace_statistics(graphs: DataFrame, nodes: str = "nodes", edges: str = "edges") -> DataFrame:
    """Mean, population deviation, min and max of node and edge counts over traces."""
    cells = [F.count(F.lit(1)).alias("traces")]
    for column, name in ((nodes, "nodes"), (edges, "edges")):
        cells += [F.avg(column).alias(f"avg_{name}"), F.stddev_pop(column).alias(f"std_{name}"),
                  F.min(column).alias(f"min_{name}"), F.max(column).alias(f"max_{name}")]
    return graphs.agg(*cells)


def pos_weight(rows: DataFrame, label: Column) -> DataFrame:
    """Negatives per positive; 1.0 without positives."""
    positive, negative = F.count_if(label == 1), F.count_if(label == 0)
    return rows.agg(negative.alias("negatives"), positive.alias("positives"),
                    F.coalesce(F.try_divide(negative.cast("double"), positive.cast("double")), F.lit(1.0)).alias("pos_weight"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels as JSON lines in the order of their trace numbers."""
    labels.orderBy(trace_number(F.col("log_filename")), "log_filename").write.mode("overwrite").json(path)


def read_labels(spark, path: str) -> DataFrame:
    """Labels written by :func:`write_labels`."""
    return spark.read.schema("log_filename string, label bigint").json(path)
