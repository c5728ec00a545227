"""Queries over labelled documents and predictions: sampling, splits, labels, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceaudit.functions.text import natural_key, normal_trace_name, rounded
from traceaudit.operators import evaluate, graph, labels, sampling
from traceaudit.operators.ranking import globally_ranked
from traceaudit.plans.registry import query
from traceaudit.plans.span_queries import NODES
from traceaudit.sources import adapters as A

LABELLED = """
lab AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, md5('42:' || d.doc_id) AS k
        FROM documents d JOIN labels l USING (doc_id))"""


def _split_sql(small: int) -> str:
    rule = f"WHEN n < {small} THEN 'train' " if small else ""
    return f"""WITH {LABELLED},
p AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY k, doc_id) AS pos, count(*) OVER (PARTITION BY lang, quality) AS n FROM lab),
q AS (SELECT *, greatest(1, round_even(n * 0.7::DOUBLE, 0)) AS nt, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS nv0 FROM p),
r AS (SELECT *, CASE WHEN n - nt - nv0 < 0 THEN greatest(0, n - nt - 1) ELSE nv0 END AS nv FROM q)
SELECT doc_id, lang, quality, CASE {rule}WHEN pos <= nt THEN 'train' WHEN pos <= nt + nv THEN 'val' ELSE 'test' END AS split FROM r"""


def _labelled(spark, folder):
    return A.labelled(spark, folder)


@query("stratified_split", _split_sql(0))
def stratified_split(spark, folder):
    """Train, validation and test rows per language and quality."""
    return sampling.stratified_split(_labelled(spark, folder), ["lang", "quality"], "doc_id").select("doc_id", "lang", "quality", "split")


@query("split_small_cells", _split_sql(30))
def split_small_cells(spark, folder):
    """The same split with strata under 30 rows kept in train."""
    out = sampling.stratified_split(_labelled(spark, folder), ["lang", "quality"], "doc_id", small_cells_to_train=30)
    return out.select("doc_id", "lang", "quality", "split")


@query("rows_of_split", _split_sql(0).replace("SELECT doc_id, lang, quality, CASE", "SELECT doc_id FROM (SELECT doc_id, CASE") + ") WHERE split = 'test'")
def rows_of_split(spark, folder):
    """Documents of the test part of the split."""
    return sampling.rows_of_split(A.table(spark, folder, "documents").select("doc_id"), stratified_split(spark, folder), "doc_id")


@query("balanced_sample", f"""WITH {LABELLED},
p AS (SELECT *, CASE toxic WHEN 1 THEN 'hard' ELSE 'soft' END AS lbl, row_number() OVER (PARTITION BY lang, toxic ORDER BY k, doc_id) AS rk FROM lab),
c AS (SELECT lang, count(*) FILTER (lbl = 'hard') AS h, count(*) FILTER (lbl = 'soft') AS s FROM p GROUP BY lang),
q AS (SELECT *, least(10 - least(5, h), s) AS ns FROM c)
SELECT doc_id, p.lang, lbl FROM p JOIN q USING (lang) WHERE rk <= CASE lbl WHEN 'soft' THEN ns ELSE least(h, 10 - ns) END""")
def balanced_sample(spark, folder):
    """Ten rows per language, half of them hard where possible."""
    rows = _labelled(spark, folder).withColumn("lbl", F.when(F.col("toxic") == 1, "hard").otherwise("soft"))
    return sampling.balanced_sample(rows, "lang", "lbl", "doc_id").select("doc_id", "lang", "lbl")


@query("rejected_sample", f"""WITH {LABELLED},
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS rk FROM lab),
n AS (SELECT greatest(1, 30 // count(DISTINCT source)) AS share FROM lab),
f AS (SELECT p.* FROM p, n WHERE rk <= share),
rest AS (SELECT p.*, row_number() OVER (ORDER BY k, doc_id) AS g FROM p, n WHERE rk > share)
SELECT doc_id, source FROM f UNION ALL SELECT doc_id, source FROM rest WHERE g <= 30 - (SELECT count(*) FROM f)""")
def rejected_sample(spark, folder):
    """Thirty rows spread over the sources."""
    return sampling.rejected_sample(_labelled(spark, folder), "source", "doc_id").select("doc_id", "source")


SAMPLE = f"""WITH {LABELLED},
tr AS (SELECT 'r' || doc_id AS run_id, doc_id, lang AS violation_id, quality = 1 AS acc, doc_id % 7 <> 0 AS pre,
         CASE toxic WHEN 1 THEN 'hard' ELSE 'soft' END AS fl, source AS reason, md5('42:r' || doc_id) AS k FROM lab),
a AS (SELECT *, row_number() OVER (PARTITION BY violation_id, fl ORDER BY k) AS rk FROM tr WHERE acc),
c AS (SELECT violation_id, count(*) FILTER (fl = 'hard') AS h, count(*) FILTER (fl = 'soft') AS s FROM a GROUP BY 1),
q AS (SELECT *, least(10 - least(5, h), s) AS ns FROM c),
acc AS (SELECT run_id FROM a JOIN q USING (violation_id) WHERE rk <= CASE fl WHEN 'soft' THEN ns ELSE least(h, 10 - ns) END),
r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY k) AS rk FROM tr WHERE NOT acc AND pre),
n AS (SELECT greatest(1, 30 // count(DISTINCT reason)) AS share FROM r),
rf AS (SELECT r.* FROM r, n WHERE rk <= share),
rr AS (SELECT r.*, row_number() OVER (ORDER BY k) AS g FROM r, n WHERE rk > share),
rej AS (SELECT run_id FROM rf UNION ALL SELECT run_id FROM rr WHERE g <= 30 - (SELECT count(*) FROM rf)),
ctl AS (SELECT 'r' || doc_id || '::ctrl' AS run_id, lang AS violation_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        ORDER BY md5('42:r' || doc_id || '::ctrl') LIMIT 10)
SELECT run_id, violation_id, CASE WHEN acc THEN 'accepted/' || violation_id ELSE 'rejected/' || reason END AS stratum, acc AS accepted
FROM tr WHERE run_id IN (SELECT run_id FROM acc UNION ALL SELECT run_id FROM rej)
UNION ALL SELECT run_id, violation_id, 'clean_control', NULL FROM ctl"""


@query("stratified_sample", SAMPLE)
def stratified_sample(spark, folder):
    """Sample manifest of accepted, rejected and control traces."""
    lab = _labelled(spark, folder)
    run = F.concat(F.lit("r"), F.col("doc_id").cast("string"))
    traces = lab.select(run.alias("run_id"), F.col("doc_id").cast("string").alias("task_id"), F.col("lang").alias("violation_id"),
                        F.lit("violation").alias("violation_category"), F.col("source").alias("target_agent"),
                        F.lit("soft").alias("designed_hard_soft"))
    stored = lab.select(run.alias("run_id"), (F.col("quality") == 1).alias("accepted"), (F.col("doc_id") % 7 != 0).alias("precheck_passed"),
                        F.when(F.col("toxic") == 1, "hard").otherwise("soft").alias("final_label"), F.col("source").alias("rejection_reason"))
    clean = A.table(spark, folder, "documents").join(A.table(spark, folder, "labels"), "doc_id", "left_anti")
    controls = clean.select(F.concat(run, F.lit("::ctrl")).alias("run_id"), F.col("doc_id").cast("string").alias("task_id"),
                            F.col("lang").alias("violation_id"), F.lit("control").alias("violation_category"),
                            F.col("source").alias("target_agent"), F.lit("none").alias("designed_hard_soft"))
    return sampling.stratified_sample(traces, stored, controls).select("run_id", "violation_id", "stratum", "accepted")


TARGETS = [("V1", "APIPlannerAgent"), ("V2", "TaskDecompositionAgent"), ("V6", "PlanControllerAgent"), ("V8", "ShortlisterAgent"),
           ("V10", "PlanControllerAgent")]


@query("assign_controls", f"""
WITH t(v, a) AS (VALUES {', '.join(str(t) for t in TARGETS)}),
o AS (SELECT doc_id, v, a, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || doc_id || ':' || v || ':' || a)) AS rk FROM documents, t)
SELECT doc_id || '::ctrl::' || v || '::' || a AS doc_id, v AS violation_id, a AS target_agent, 'control' AS violation_category,
  'clean_control' AS violation_name, 'none' AS designed_hard_soft FROM o WHERE rk = 1""")
def assign_controls(spark, folder):
    """One synthetic target per document."""
    return sampling.assign_controls(A.table(spark, folder, "documents").select("doc_id"), TARGETS, "doc_id")


@query("encode_labels", """
WITH m AS (SELECT *, row_number() OVER (PARTITION BY NULL) AS r FROM documents WHERE doc_id % 9 <> 0)
SELECT 'trace' || doc_id || '.log' AS log_filename, lang AS agent, source AS violation_id,
  dense_rank() OVER (ORDER BY lang) - 1 AS agent_code, dense_rank() OVER (ORDER BY source) - 1 AS violation_code FROM m""")
def encode_labels(spark, folder):
    """Label codes per log file of a manifest."""
    manifest = A.table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("logs/"), F.col("source"), F.lit("/trace"), F.col("doc_id").cast("string"), F.lit(".log"))).alias("log_path"),
        F.col("lang").alias("agent"), F.col("source").alias("violation_id"))
    return labels.encode_labels(manifest)


POSITIONAL = """
f AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM (SELECT 'trace' || lpad(CAST(doc_id AS VARCHAR), 2, '0') || '.log' AS name FROM documents WHERE doc_id < 100
        UNION ALL SELECT 'trace' || doc_id || '.log' FROM documents WHERE doc_id >= 100)),
r AS (SELECT quality AS score, toxic = 1 AS exception, row_number() OVER (ORDER BY doc_id) AS pos FROM labels),
j AS (SELECT f.name, r.score, r.exception, f.pos, CASE WHEN CAST(regexp_extract(name, 'trace(\\d+)', 1) AS BIGINT) < 10
        THEN 'trace' || CAST(regexp_extract(name, 'trace(\\d+)', 1) AS BIGINT) || '.log' ELSE name END AS norm FROM f JOIN r USING (pos))"""


def _files(spark, folder):
    number = F.col("doc_id").cast("string")
    padded = F.when(F.col("doc_id") < 100, F.lpad(number, 2, "0")).otherwise(number)
    return A.table(spark, folder, "documents").select(F.concat(F.lit("trace"), padded, F.lit(".log")).alias("log_file"))


def _results(spark, folder):
    return A.table(spark, folder, "labels").select(
        F.col("quality").alias("score"), (F.col("toxic") == 1).alias("exception"), F.col("doc_id").alias("row_no"))


@query("positional_labels", f"""WITH {POSITIONAL}
SELECT norm AS log_filename, name AS original_name, CAST(score AS BIGINT) AS label, pos - 1 AS csv_row, exception FROM j""")
def positional_labels(spark, folder):
    """Labels by position: the i-th result row belongs to the i-th file name."""
    return labels.positional_labels(_files(spark, folder), _results(spark, folder))


@query("unlabelled_files", f"""WITH {POSITIONAL} SELECT name AS log_file FROM f WHERE pos > (SELECT count(*) FROM r)""")
def unlabelled_files(spark, folder):
    """Files without a positional label."""
    found = positional_labels(spark, folder)
    return labels.unlabelled_files(_files(spark, folder), found).select("log_file")


@query("label_report", """SELECT count(*) FILTER (quality = 0) AS failures, count(*) FILTER (quality = 1) AS successes,
  round(avg(toxic), 9) AS exception_rate, round(avg((quality = 1 - toxic)::INT), 9) AS exception_agreement FROM labels""")
def label_report(spark, folder):
    """Label counts and agreement of exceptions with failures."""
    out = labels.label_report(_results(spark, folder))
    return out.withColumns({c: rounded(F.col(c), 9) for c in ("exception_rate", "exception_agreement")})


@query("attach_labels", """
WITH g AS (SELECT conv_id, 'trace' || conv_id || '.log' AS log_filename, count(*) AS nodes FROM conversations GROUP BY conv_id)
SELECT g.log_filename, nodes, CAST(quality AS BIGINT) AS y_agent, CAST(toxic AS BIGINT) AS y_violation
FROM g JOIN labels l ON g.conv_id = l.doc_id""")
def attach_labels(spark, folder):
    """Graphs with the codes of their labels; unlabelled graphs are left out."""
    graphs = A.table(spark, folder, "conversations").groupBy(
        F.concat(F.lit("trace"), F.col("conv_id").cast("string"), F.lit(".log")).alias("log_filename")).agg(F.count(F.lit(1)).alias("nodes"))
    codes = A.table(spark, folder, "labels").select(
        F.concat(F.lit("trace"), F.col("doc_id").cast("string"), F.lit(".log")).alias("log_filename"),
        F.col("quality").cast("bigint").alias("agent_code"), F.col("toxic").cast("bigint").alias("failure_code"))
    return labels.attach_labels(graphs, codes)


@query("labels_without_data", """SELECT 'trace' || doc_id || '.log' AS log_filename, CAST(quality AS BIGINT) AS label FROM labels
WHERE doc_id NOT IN (SELECT conv_id FROM conversations)""")
def labels_without_data(spark, folder):
    """Labels whose graph is missing."""
    graphs = A.table(spark, folder, "conversations").select(F.concat(F.lit("trace"), F.col("conv_id").cast("string"), F.lit(".log")).alias("log_filename")).distinct()
    rows = A.table(spark, folder, "labels").select(F.concat(F.lit("trace"), F.col("doc_id").cast("string"), F.lit(".log")).alias("log_filename"),
                                                   F.col("quality").cast("bigint").alias("label"))
    return labels.labels_without_data(graphs, rows)


@query("class_distribution", f"""WITH {LABELLED} SELECT lang, quality, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lab), 6) AS pct FROM lab GROUP BY ALL""")
def class_distribution(spark, folder):
    """Share of every (language, quality) pair."""
    out = labels.class_distribution(_labelled(spark, folder), ["lang", "quality"])
    return out.withColumn("pct", rounded(F.col("pct")))


@query("trace_statistics", f"""WITH {NODES},
g AS (SELECT trace_id, count(*) AS nodes, count(parent_idx) AS edges FROM node GROUP BY trace_id)
SELECT count(*) AS traces, round(avg(nodes), 6) AS avg_nodes, round(stddev_pop(nodes), 6) AS std_nodes, min(nodes) AS min_nodes, max(nodes) AS max_nodes,
  round(avg(edges), 6) AS avg_edges, round(stddev_pop(edges), 6) AS std_edges, min(edges) AS min_edges, max(edges) AS max_edges FROM g""")
def trace_statistics(spark, folder):
    """Node and edge statistics over traces."""
    out = labels.trace_statistics(graph.graph_quality(graph.build_trace_graph(A.conversation_spans(spark, folder))))
    return out.withColumns({c: rounded(F.col(c)) for c in ("avg_nodes", "std_nodes", "avg_edges", "std_edges")})


@query("pos_weight", """SELECT count(*) FILTER (quality = 0) AS negatives, count(*) FILTER (quality = 1) AS positives,
  round(count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1)::DOUBLE, 9) AS pos_weight FROM labels""")
def pos_weight(spark, folder):
    """Class weight of the positives."""
    out = labels.pos_weight(A.table(spark, folder, "labels"), F.col("quality"))
    return out.withColumn("pos_weight", rounded(F.col("pos_weight"), 9))


@query("natural_order", """SELECT 'trace' || doc_id || '.log' AS name, row_number() OVER (ORDER BY doc_id) AS pos FROM documents""")
def natural_order(spark, folder):
    """Position of every file name when embedded numbers sort by value."""
    names = A.table(spark, folder, "documents").select(F.concat(F.lit("trace"), F.col("doc_id").cast("string"), F.lit(".log")).alias("name"))
    return globally_ranked(names, [natural_key(F.col("name"))])


@query("normal_names", """SELECT doc_id, CASE WHEN doc_id < 10 THEN 'trace' || doc_id || '.log' ELSE 'trace0' || doc_id || '.log' END AS name FROM documents""")
def normal_names(spark, folder):
    """File names with single-digit padding removed."""
    d = A.table(spark, folder, "documents")
    return d.select("doc_id", normal_trace_name(F.concat(F.lit("trace0"), F.col("doc_id").cast("string"), F.lit(".log"))).alias("name"))


PREDICTED = """
pr AS (SELECT vec_id, label, CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 AS u FROM embeddings),
pred AS (SELECT vec_id, 'c' || label AS y_true, CASE WHEN u < 5 THEN NULL WHEN u < 35 THEN 'c' || ((label + 1) % 10) ELSE 'c' || label END AS y_pred, u FROM pr),
used AS (SELECT * FROM pred WHERE y_pred IS NOT NULL),
cls AS (SELECT y_true AS label FROM used UNION SELECT y_pred FROM used),
per AS (SELECT c.label, count(*) FILTER (u.y_true = c.label) AS support, count(*) FILTER (u.y_pred = c.label) AS predicted,
          count(*) FILTER (u.y_true = c.label AND u.y_pred = c.label) AS hits FROM cls c, used u GROUP BY c.label),
rep AS (SELECT label, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS p, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS r,
          coalesce(2.0::DOUBLE * hits / nullif(support + predicted, 0), 0) AS f, support, hits FROM per)"""


@query("confusion_matrix", f"""WITH {PREDICTED}
SELECT a.label AS y_true, b.label AS y_pred, count(u.vec_id) AS n,
  round(coalesce(count(u.vec_id) / nullif((SELECT count(*) FROM used x WHERE x.y_true = a.label), 0)::DOUBLE, 0), 6) AS share
FROM cls a CROSS JOIN cls b LEFT JOIN used u ON u.y_true = a.label AND u.y_pred = b.label GROUP BY a.label, b.label""")
def confusion_matrix(spark, folder):
    """Counts and row shares of all class pairs."""
    out = evaluate.confusion_matrix(A.predictions(spark, folder))
    return out.withColumn("share", rounded(F.col("share")))


@query("classification_report", f"""WITH {PREDICTED}
SELECT 'class' AS "row", label, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, support FROM rep
UNION ALL SELECT 'average', 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT 'average', 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep""")
def classification_report(spark, folder):
    """Per-class scores with macro and weighted averages."""
    out = evaluate.classification_report(A.predictions(spark, folder))
    return out.withColumns({c: rounded(F.col(c)) for c in ("precision", "recall", "f1")})


@query("macro_metrics", f"""WITH {PREDICTED}
SELECT round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(p), 6) AS "precision", round(avg(r), 6) AS recall, round(avg(f), 6) AS f1,
  CAST(sum(support) AS BIGINT) AS n FROM rep""")
def macro_metrics(spark, folder):
    """Accuracy and macro scores."""
    out = evaluate.macro_metrics(A.predictions(spark, folder))
    return out.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "precision", "recall", "f1")})


@query("run_summary", f"""WITH {PREDICTED},
c AS (SELECT *, ((1000 + u) * 2 + (u % 10) * 8) / 1000000.0::DOUBLE AS cost, u / 10.0::DOUBLE AS lat FROM pred)
SELECT count(*) AS n, count(*) FILTER (y_pred IS NULL) AS parse_failures, round(avg((y_pred IS NULL)::INT), 6) AS parse_failure_rate,
  round(sum(cost), 6) AS total_cost, round(avg(cost), 9) AS avg_cost, round(sum(lat), 6) AS total_latency, round(avg(lat), 6) AS avg_latency FROM c""")
def run_summary(spark, folder):
    """Parse failures, cost and latency of a prediction run."""
    p = A.predictions(spark, folder)
    out = evaluate.run_summary(p, ["y_pred"], evaluate.call_cost(F.col("prompt_tokens"), F.col("completion_tokens")), F.col("latency_s"))
    digits = {"parse_failure_rate": 6, "total_cost": 6, "avg_cost": 9, "total_latency": 6, "avg_latency": 6}
    return out.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


@query("evaluate_runs", """
WITH s AS (SELECT event_type AS model, user_id % 5 AS seed, avg(value) / 500 AS a, avg(value) / 400 AS v FROM events GROUP BY ALL)
SELECT model, round(avg(a), 6) AS agent_f1_mean, round(stddev_pop(a), 6) AS agent_f1_std, round(avg(v), 6) AS violation_f1_mean,
  round(stddev_pop(v), 6) AS violation_f1_std, count(*) AS runs, round((avg(a) + avg(v)) / 2, 6) AS average FROM s GROUP BY model""")
def evaluate_runs(spark, folder):
    """Mean and deviation over seeds per model."""
    scores = A.table(spark, folder, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("seed")).agg(
        (F.avg("value") / 500).alias("agent_f1"), (F.avg("value") / 400).alias("violation_f1"))
    out = evaluate.evaluate_runs(scores)
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c not in ("model", "runs")})


@query("early_stop", """
WITH RECURSIVE e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
    count(*) OVER (PARTITION BY user_id) AS epochs, (value / 500 + value / 400) / 2.0 AS m FROM events),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS epoch, 0.0::DOUBLE AS best, CAST(0 AS BIGINT) AS best_epoch FROM (SELECT DISTINCT run_id FROM e)
  UNION ALL SELECT f.run_id, e.epoch, CASE WHEN e.m > f.best + 0.001 THEN e.m ELSE f.best END,
     CASE WHEN e.m > f.best + 0.001 THEN e.epoch ELSE f.best_epoch END
  FROM f JOIN e ON e.run_id = f.run_id AND e.epoch = f.epoch + 1 WHERE f.epoch - f.best_epoch < 20),
last_ AS (SELECT run_id, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best, epoch) AS best, max(epoch) AS last_epoch FROM f GROUP BY run_id)
SELECT run_id, best_epoch, round(best, 9) AS best_metric, last_epoch, last_epoch - best_epoch >= 20 AS stopped_early FROM last_""")
def early_stop(spark, folder):
    """Best and last epoch per run with patience 20."""
    metric = (F.col("agent_f1") + F.col("violation_f1")) / 2.0
    out = evaluate.early_stop(A.epochs(spark, folder), metric)
    return out.withColumn("best_metric", rounded(F.col("best_metric"), 9))


@query("known_or_null", """SELECT event_id, CASE WHEN v IN ('V1', 'V2', 'V4') THEN v END AS violation
FROM (SELECT event_id, 'V' || event_id % 5 AS v FROM events WHERE true)
WHERE true""")
def known_or_null(spark, folder):
    """Predictions outside the known violations become null."""
    e = A.table(spark, folder, "events")
    raw = F.concat(F.lit(" V"), (F.col("event_id") % 5).cast("string"))
    return e.select("event_id", evaluate.known_or_null(raw, evaluate.VIOLATIONS).alias("violation"))


@query("fit_linear")
def fit_linear(spark, folder):
    """Softmax regression on the vectors, with the predicted label of each row."""
    v = A.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("string").alias("label"))
    return evaluate.fit_baseline(v, "label", "linear")[2].select("vec_id", "label", "prediction_label")


@query("fit_mlp")
def fit_mlp(spark, folder):
    """Multilayer perceptron on the vectors, with the predicted label of each row."""
    v = A.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("string").alias("label"))
    return evaluate.fit_baseline(v, "label", "mlp", width=64, hidden=(32,))[2].select("vec_id", "label", "prediction_label")


@query("prediction_replies", """SELECT event_id,
  CASE WHEN event_id % 5 IN (0, 1) THEN CASE event_id % 3 WHEN 0 THEN 'V6' WHEN 1 THEN 'V3a' END END AS pred_violation,
  CASE WHEN event_id % 5 IN (0, 1) THEN 'CodeAgent' END AS pred_agent FROM events""")
def prediction_replies(spark, folder):
    """Violation and agent read from raw prediction replies; broken replies and unknown names are null."""
    e, n = A.table(spark, folder, "events"), F.col("event_id")
    kind = F.when(n % 3 == 0, "V6").when(n % 3 == 1, " V3a ").otherwise("V99")
    body = F.concat(F.lit('{"violation_type": "'), kind, F.lit('", "sub_agent": "CodeAgent"}'))
    raw = F.when(n % 5 <= 1, body).when(n % 5 == 2, F.concat(F.lit("I think "), body)).when(n % 5 == 3, '["V6"]').otherwise("")
    return evaluate.read_predictions(e.select("event_id", raw.alias("raw"))).drop("raw")
