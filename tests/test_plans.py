"""Plan shapes that matter at scale, and the chained jobs."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_judging import REPLIES
from traceaudit.operators import agreement, judging, sampling, signatures
from traceaudit.plans import workflows
from traceaudit.sources import adapters as A

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned_at_the_scan(spark):
    text = plan(judging.consensus(A.judgments(spark, FOLDER)))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text


def test_consensus_combines_before_its_only_shuffle(spark):
    text = plan(judging.consensus(A.judgments(spark, FOLDER)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_pairs_need_no_self_join(spark):
    text = plan(agreement.contingency(judging.consensus(A.judgments(spark, FOLDER)), A.JUDGES))
    assert "Join" not in text and text.count("FileScan") == 1


def test_top_rows_are_cut_before_the_shuffle(spark):
    rows = A.labelled(spark, FOLDER).withColumn("lbl", F.when(F.col("toxic") == 1, "hard").otherwise("soft"))
    assert "WindowGroupLimit" in plan(sampling.balanced_sample(rows, "lang", "lbl", "doc_id"))


def test_no_window_over_a_whole_key_or_table(spark):
    text = plan(sampling.stratified_split(A.labelled(spark, FOLDER), ["lang"], "doc_id"))
    sides = re.findall(r"Window \[row_number\(\).*?\], \[([^\]]*)\]", text)
    assert sides and all("__b" in s for s in sides)


def test_term_weights_do_not_shuffle_terms(spark):
    docs = A.table(spark, FOLDER, "documents").select("doc_id", "text")
    lists = signatures.word_lists(docs, "doc_id", "text")
    vocab = signatures.fixed_vocabulary(signatures.vocabulary(lists, 50))
    assert "Exchange hashpartitioning" not in plan(signatures.term_weights(lists, "doc_id", vocab))


@pytest.mark.parametrize("name", ["consensus_cross_judge", "pairwise_kappa", "pending_judgments", "assign_controls", "confusion_matrix",
                                  "trace_graph_edges", "stratified_sample"])
def test_no_cross_joins(spark, name):
    from __spark_entry__ import queries
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_preprocessing(spark):
    spans = A.conversation_spans(spark, FOLDER).select(
        "*", F.create_map(F.lit("gen_ai.prompt.0.content"), F.concat(F.lit("Plan and answer as "), "role"),
                          F.lit("gen_ai.prompt.1.content"), F.col("text")).alias("input"),
        F.create_map(F.lit("gen_ai.completion.0.content"), F.col("text")).alias("output"),
        F.create_map(F.lit("num_input_tokens"), F.lit("3")).alias("attributes"))
    nodes, edges, meta = workflows.preprocess_traces(spans, dim=16, batch_size=2, with_names=True)
    n = nodes.count()
    info = meta.first()
    assert n == info.nodes and info.total_dim == 124 and edges.count() == n - info.traces
    assert nodes.filter(F.size("features") != 124).count() == 0
    assert nodes.select("batch_id").distinct().count() == -(-info.traces // 2)


def test_validation(spark):
    texts = [("r1", "keep\ndrop", "keep"), ("r2", "same", "same")]
    traces = spark.createDataFrame([(r, "V1", "A", o, m, "u", "a", "soft") for r, o, m in texts],
                                   "run_id string, violation_id string, target_agent string, original_system_prompt string, "
                                   "modified_system_prompt string, user_input string, agent_response string, designed_hard_soft string")
    policies = spark.createDataFrame([("V1", "A", "p", "i")], "violation_id string, target_agent string, policy_text string, indicators string")
    raw = {"j1": '{"judgment": "policy_absent"}', "j2": 'so {"judgment": "hard_violation"}'}
    replies = spark.createDataFrame([("r1", "J", s, i, t) for s, t in raw.items() for i in range(3)],
                                    "trace_id string, judge_model string, stage string, run_idx bigint, raw string")
    out = workflows.validate_runs(traces, policies, {"j1": "{policy_text}", "j2": "{agent_response}"}, replies)
    assert {(r.trace_id, r.stage, r.prompt) for r in out["prompts"].collect()} == {("r1", "j1", "p"), ("r1", "j2", "a")}
    got = {r.trace_id: (r.accepted, r.final_label, r.reclassified, r.rejection_reason) for r in out["verdicts"].collect()}
    assert got == {"r1": (True, "hard", True, None), "r2": (False, None, False, "injection_failed_no_diff")}
    assert out["summary"].first().accepted_pct == 50.0


def test_judge_study(spark):
    ledger = A.judgments(spark, FOLDER)
    groups = ledger.select("trace_id").distinct().withColumn("violation_id", F.concat(F.lit("V"), (F.col("trace_id") % 3).cast("string")))
    out = workflows.judge_study(ledger, A.JUDGES, groups=groups, replicates=50)
    assert out["kappa"].count() == 6 and out["fleiss"].count() == 2 and out["overlap"].count() == 3
    assert all(r.ci_low <= r.kappa <= r.ci_high for r in out["kappa"].collect() if r.kappa is not None)
    assert out["examples"].select("trace_id").distinct().count() == out["disagreements"].count() == 10


def test_train_and_score(spark):
    nodes = A.table(spark, FOLDER, "embeddings").select((F.col("vec_id")).alias("trace_id"), F.col("embedding").alias("features"))
    codes = A.table(spark, FOLDER, "embeddings").select(F.col("vec_id").alias("trace_id"), (F.col("label") % 2).cast("bigint").alias("agent_code"),
                                                        (F.col("label") % 3).cast("bigint").alias("violation_code"))
    out = workflows.train_and_score(nodes, codes, 64)
    assert {r.split for r in out["split"].select("split").distinct().collect()} == {"train", "val", "test"}
    assert 0 <= out["y_agent_metrics"].first().f1 <= 1 and out["y_violation_confusion"].count() == 9


def test_replies_case_list_is_covered():
    assert len({r[0] for r in REPLIES}) == len(REPLIES)
