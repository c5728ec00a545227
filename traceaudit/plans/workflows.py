"""The jobs chained end to end: preprocessing, validation, judge agreement, training data to scores.

Every function takes and returns DataFrames and leaves planning to Spark; what
is written and when is up to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.operators import agreement, evaluate, features, graph, judging, labels, rewrite, sampling, selection, signatures


def preprocess_traces(spans: DataFrame, dim: int = 384, encoder: Callable[[Column], Column] | None = None,
                      batch_size: int = 100, with_names: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans to (nodes with features and batch id, edges with batch id, one metadata row).

    ``spans`` has the graph columns plus ``name`` and the ``input``, ``output`` and ``attributes`` maps.
    """
    nodes = graph.build_trace_graph(spans)
    calls = features.call_texts(nodes)
    prompts = signatures.distinct_prompts(calls.filter(F.col("node_type") == "llm_call"), "system_prompt")
    signed = signatures.text_signatures(prompts, "prompt_hash", "prompt")
    names = signatures.node_name_signatures(features.common_features(nodes)) if with_names else None
    whole = features.assemble_features(calls, signed, names, dim, encoder)
    batches = graph.batch_ids(nodes, batch_size)
    # One batch row per trace joins many node rows; Spark splits a hot trace on the node side.
    out = whole.join(batches, "trace_id")
    edges = graph.edges_of(nodes).join(batches, "trace_id")
    return out, edges, features.feature_metadata(whole, dim)


def validation_texts(spans: DataFrame, manifest: DataFrame) -> DataFrame:
    """Texts of every manifest run, from its most informative iteration."""
    runs = manifest.select("log_file", F.col("agent").alias("target_agent"), "violation_id").distinct()
    return selection.select_informative_span(spans, runs).drop("violation_id")


def validate_runs(traces: DataFrame, policies: DataFrame, templates: dict[str, str],
                  replies: DataFrame | None = None) -> dict[str, DataFrame]:
    """Precheck, judge prompts and, once ``replies`` are there, verdicts and their summary.

    Prompts are rendered only for traces that pass the precheck. ``replies``
    holds ``trace_id, judge_model, stage, run_idx, raw``.
    """
    checked = rewrite.precheck_diff(traces.withColumn("__o", F.col("original_system_prompt")).withColumn(
        "__m", F.col("modified_system_prompt")), "__o", "__m")
    passed = checked.filter(F.col("status") == "PASS")
    out = {"precheck": checked,
           "prompts": judging.render_judge_prompts(passed.withColumnRenamed("run_id", "trace_id"), policies, templates)}
    if replies is not None:
        gate = checked.select(F.col("run_id").alias("trace_id"), (F.col("status") == "PASS").alias("precheck_passed"),
                              "designed_hard_soft")
        out["verdicts"] = judging.trace_verdicts(gate, judging.parse_verdicts(replies))
        out["summary"] = judging.acceptance_summary(out["verdicts"])
    return out


def judge_study(ledger: DataFrame, judges: Sequence[str], stored: DataFrame | None = None,
                stored_judge: str | None = None, groups: DataFrame | None = None, replicates: int = 1000,
                top_n: int = 10) -> dict[str, DataFrame]:
    """Consensus of every judge and all agreement tables.

    ``groups`` (``trace_id, violation_id``) adds the kappas per violation.
    """
    rows = judging.consensus(ledger)
    if stored is not None:
        rows = judging.merge_consensus(rows, stored, stored_judge)
    out = {"consensus": rows, "kappa": agreement.kappa_bootstrap(rows, judges, replicates=replicates),
           "overlap": agreement.acceptance_overlap(rows, judges), "labels": agreement.label_agreement(rows, judges)}
    if len(judges) >= 3:
        out["fleiss"] = agreement.fleiss_kappa(rows, judges)
    if groups is not None:
        out["per_violation"] = agreement.kappa_by_group(rows.join(groups, "trace_id"), "violation_id", judges)
    out["disagreements"] = agreement.disagreements(rows, judges, top_n)
    out["examples"] = agreement.disagreement_examples(out["disagreements"], ledger)
    return out


def train_and_score(nodes: DataFrame, codes: DataFrame, width: int, kind: str = "linear", seed: int = 42) -> dict[str, DataFrame]:
    """Pool node vectors, attach labels, split, fit both heads on train and score the test rows.

    ``nodes`` holds ``trace_id, features``; ``codes`` holds ``trace_id, agent_code, violation_code``.
    """
    pooled = graph.pool_graph(nodes, width).withColumn("log_filename", F.col("trace_id").cast("string"))
    keyed = codes.withColumn("log_filename", F.col("trace_id").cast("string")).drop("trace_id")
    rows = labels.attach_labels(pooled, keyed)
    split = sampling.stratified_split(rows, ["y_agent", "y_violation"], "log_filename", seed)
    out = {"split": split}
    for head in ("y_agent", "y_violation"):
        named = split.withColumn(head, F.col(head).cast("string"))
        model, names, _ = evaluate.fit_baseline(named.filter("split = 'train'"), head, kind, width=width, seed=seed)
        scored = evaluate.apply_baseline(model, names, named.filter("split = 'test'"), head)
        out[f"{head}_metrics"] = evaluate.macro_metrics(scored, head, "prediction_label")
        out[f"{head}_confusion"] = evaluate.confusion_matrix(scored, head, "prediction_label")
    return out
