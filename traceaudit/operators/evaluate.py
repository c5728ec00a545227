"""Evaluation of predictions and training runs, and the feature baselines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.operators.labels import label_codes
from traceaudit.operators.ranking import ranked, running_max
from traceaudit.session import cut_lineage

# The violation ids and agent names a prediction may use.
VIOLATIONS = ("V1", "V2", "V3a", "V3b", "V4", "V5", "V6", "V7", "V8", "V9", "V10", "V11")
AGENTS = ("APIPlannerAgent", "APICodePlannerAgent", "FinalAnswerAgent", "PlanControllerAgent",
          "ShortlisterAgent", "TaskDecompositionAgent", "TaskAnalyzerAgent", "CodeAgent")


def known_or_null(value: Column, allowed: Sequence[str]) -> Column:
    """Trimmed value if it is an allowed one, otherwise null."""
    return F.when(F.trim(value).isin(*allowed), F.trim(value))


def read_predictions(replies: DataFrame, raw: str = "raw", violations: Sequence[str] = VIOLATIONS,
                     agents: Sequence[str] = AGENTS) -> DataFrame:
    """Predicted violation and agent of raw replies, as ``pred_violation`` and ``pred_agent``.

    A reply that is not a JSON object, or names what is not allowed, gives nulls.
    """
    value = F.try_parse_json(F.col(raw))

    def field(name: str, allowed: Sequence[str]) -> Column:
        return known_or_null(F.try_variant_get(value, f"$.{name}", "string"), allowed)

    return replies.withColumns({"pred_violation": field("violation_type", violations), "pred_agent": field("sub_agent", agents)})


def call_cost(prompt_tokens: Column, completion_tokens: Column, prompt_rate: float = 2.0,
              completion_rate: float = 8.0) -> Column:
    """Cost of a call in USD; rates are USD per million tokens."""
    return F.coalesce((prompt_tokens * prompt_rate + completion_tokens * completion_rate) / 1_000_000.0, F.lit(0.0))


def _cells(rows: DataFrame, true: str, pred: str, by: Sequence[str]) -> DataFrame:
    used = rows.filter(F.col(pred).isNotNull() & F.col(true).isNotNull())
    return used.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All pairs of classes with their count (zeros included) and share of the true class."""
    cells = _cells(rows, true, pred, [])
    classes = cut_lineage(label_codes(cells.select(F.explode(F.array("y_true", "y_pred")).alias("c")), "c"))
    size = classes.count()
    # Each class meets each code: the zero cells of the matrix are asked for.
    codes = F.explode(F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(size).cast("bigint")), 1, size))
    grid = classes.select(F.col("c").alias("y_true"), codes.alias("code")).join(
        classes.withColumnRenamed("c", "y_pred"), "code").drop("code")
    full = grid.join(cells, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    support = cells.groupBy("y_true").agg(F.sum("n").alias("__support"))
    return full.join(support, "y_true", "left").select(
        "y_true", "y_pred", "n",
        F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("__support").cast("double")), F.lit(0.0)).alias("share"))


def _per_class(rows: DataFrame, true: str, pred: str, by: Sequence[str]) -> DataFrame:
    cells = _cells(rows, true, pred, by)
    sides = cells.select(*by, F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))))
    counts = sides.groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                             F.sum("hits").alias("hits"))
    def ratio(a: str, b: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    return counts.select(
        *by, "label", ratio("hits", F.col("predicted")).alias("precision"), ratio("hits", F.col("support")).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.col("predicted")).cast("double")),
                   F.lit(0.0)).alias("f1"), "support", "hits")


def classification_report(rows: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages.

    Rows without a prediction are left out; classes are those seen on either side.
    """
    per_class = _per_class(rows, true, pred, [])
    named = per_class.select(F.lit("class").alias("row"), "label", "precision", "recall", "f1", "support")
    def mean(weight: Column | None) -> list[Column]:
        if weight is None:
            return [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
        return [F.try_divide(F.sum(F.col(c) * weight), F.sum(weight)).alias(c) for c in ("precision", "recall", "f1")]
    macro = per_class.agg(*mean(None), F.sum("support").alias("support")).select(
        F.lit("average").alias("row"), F.lit("macro").alias("label"), "precision", "recall", "f1", "support")
    weighted = per_class.agg(*mean(F.col("support")), F.sum("support").alias("support_")).select(
        F.lit("average").alias("row"), F.lit("weighted").alias("label"), "precision", "recall", "f1",
        F.col("support_").alias("support"))
    return named.unionByName(macro).unionByName(weighted)


def macro_metrics(rows: DataFrame, true: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over rows with a prediction."""
    per_class = _per_class(rows, true, pred, by)
    return per_class.groupBy(*by).agg(
        F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double")).alias("accuracy"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
        F.sum("support").alias("n"))


def run_summary(rows: DataFrame, preds: Sequence[str], cost: Column, latency: Column) -> DataFrame:
    """Rows, parse failures, total and average cost and latency."""
    failed = F.lit(False)
    for name in preds:
        failed = failed | F.col(name).isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("parse_failures"),
        F.avg(failed.cast("int")).alias("parse_failure_rate"), F.sum(cost).alias("total_cost"),
        F.avg(cost).alias("avg_cost"), F.sum(latency).alias("total_latency"), F.avg(latency).alias("avg_latency"))


def evaluate_runs(scores: DataFrame, model: str = "model",
                  metrics: Sequence[str] = ("agent_f1", "violation_f1")) -> DataFrame:
    """Mean and deviation of each metric over the seeds of a model, and the average of the means."""
    cells = []
    for m in metrics:
        cells += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    out = scores.groupBy(model).agg(*cells, F.count(F.lit(1)).alias("runs"))
    total = sum((F.col(f"{m}_mean") for m in metrics[1:]), F.col(f"{metrics[0]}_mean"))
    return out.withColumn("average", total / len(metrics))


def early_stop(epochs: DataFrame, metric: Column, run: str = "run_id", order: str = "step",
               min_delta: float = 0.001, patience: int = 20, bucket_size: int = 4096) -> DataFrame:
    """Best and last epoch per run under early stopping.

    An epoch is a new best when its metric beats the best so far by more than
    ``min_delta``; training stops after ``patience`` epochs without one. Only
    epochs above everything before them can be a new best, so just those go, in
    order, through the fold of their run, which holds the best and its epoch;
    numbering the epochs and finding them runs in buckets.
    """
    bucket = F.floor(F.col(order) / bucket_size)
    rows = epochs.select(run, F.col(order), metric.alias("__m"))
    placed = ranked(rows, [run], [order], bucket, "epoch", "epochs")
    marked = running_max(placed, [run], ["epoch"], F.floor(F.col("epoch") / bucket_size), F.col("__m"), "__before")
    peaks = marked.filter(F.col("__before").isNull() | (F.col("__m") > F.col("__before")))
    peaks = peaks.select(run, F.col("epoch").cast("bigint").alias("epoch"), F.col("__m").cast("double").alias("m"), F.col("epochs").cast("bigint").alias("epochs"))
    kind = peaks.schema[run].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run is four numbers, however many epochs raise its metric.
        held = None
        for batch in batches:
            ended = []
            for name, epoch, m, epochs_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is None or held[0] != name:
                    ended += [held[:4]] if held else []
                    held = [name, 0, 0.0, epochs_, False]
                if held[4] or epoch - held[1] > patience:
                    held[4] = True
                elif m > held[2] + min_delta:
                    held[1], held[2] = epoch, m
            if ended:
                yield _columns(ended, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if held is not None:
            yield _columns([held[:4]], last)

    out = (peaks.repartition(run).sortWithinPartitions(run, "epoch")
           .mapInArrow(fold, f"`{run}` {kind}, best_epoch bigint, best_metric double, epochs bigint"))
    stops = F.col("best_epoch") + patience
    return out.select(run, "best_epoch", "best_metric", F.least("epochs", stops).alias("last_epoch"), (F.col("epochs") >= stops).alias("stopped_early"))


def _columns(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(parts[0], kind), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64()), pa.array(parts[3], pa.int64())],
                                      names=["run", "best_epoch", "best_metric", "epochs"])


def fit_baseline(vectors: DataFrame, label: str, kind: str = "linear", features: str = "features",
                 width: int | None = None, hidden: Sequence[int] = (64,), max_iter: int = 50, seed: int = 42):
    """Train a classifier on pooled vectors; returns (model, label codes, training rows with predictions).

    ``linear`` is softmax regression, ``mlp`` a network with hidden layers. The
    predicted label comes back as text in ``prediction_label``.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    from traceaudit.operators.lookup import lookup_join

    codes = label_codes(vectors, label, "__code")
    ready = lookup_join(vectors, codes, [label]).withColumn(
        "__x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("__y", F.col("__code").cast("double"))
    if kind == "linear":
        learner = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__prob",
                                     rawPredictionCol="__raw", maxIter=max_iter, family="multinomial")
    elif kind == "mlp":
        classes = codes.count()
        size = width or ready.select(F.size(features)).first()[0]
        learner = MultilayerPerceptronClassifier(
            featuresCol="__x", labelCol="__y", predictionCol="__p", probabilityCol="__prob", rawPredictionCol="__raw",
            layers=[size, *hidden, classes], maxIter=max_iter, seed=seed)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    model = learner.fit(ready)
    return model, codes, apply_baseline(model, codes, vectors, label, features)


def apply_baseline(model, codes: DataFrame, vectors: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Rows with the label a fitted baseline predicts, as text in ``prediction_label``."""
    from pyspark.ml.functions import array_to_vector

    from traceaudit.operators.lookup import lookup_join

    ready = vectors.withColumn("__x", array_to_vector(F.col(features).cast("array<double>")))
    scored = model.transform(ready).withColumn("__code_p", F.col("__p").cast("bigint"))
    back = codes.select(F.col("__code").alias("__code_p"), F.col(label).alias("prediction_label"))
    return lookup_join(scored, back, ["__code_p"]).drop("__x", "__p", "__prob", "__raw", "__code_p")
