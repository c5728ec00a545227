"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled documents, every path of a tree is read as a
rule (a conjunction of thresholds on the statistics), a lasso logistic
regression keeps the few rules that matter, and these are compiled into one
Spark column expression. Scoring is a projection: no join, no shuffle, no
Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import WORD, fold_of, hash31, stored

# Labelled rows of one class that a fit reads at most, drawn by hash.
CLASS_ROWS = 8_000
STATISTICS = ("words", "word_length", "upper", "digit", "symbol", "shout", "stop", "repeat_words", "distinct_words",
              "repeat_lines", "line_length", "short_words")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÑÁÍÓÚÊÂÎÔÛ"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_s_<name>`` for each of ``STATISTICS``; null texts count as empty.

    All are counts or shares over the whole text. Shares of nothing are 0.
    """
    t = F.col("_t")
    chars = F.greatest(F.lit(1), F.col("_chars"))
    words = F.greatest(F.lit(1), F.col("_n"))
    lines = F.greatest(F.lit(1), F.size("_lines"))
    without = lambda letters: (F.col("_chars") - F.length(F.translate(t, letters, ""))) / chars
    base = (docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
            .withColumns({"_chars": F.length(t), "_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), "_lines": F.split(t, "\n")})
            .withColumn("_n", F.size("_words")))
    return base.withColumns({
        "_s_words": F.log1p(F.col("_n").cast("double")),
        "_s_word_length": F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)) / words,
        "_s_upper": without(UPPER),
        "_s_digit": without("0123456789"),
        "_s_symbol": without("#$%&*@^~<>|{}[]\\_=+/"),
        "_s_shout": without("!?"),
        "_s_stop": without(".,;:"),
        "_s_repeat_words": F.regexp_count(t, F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))")) / words,
        "_s_distinct_words": F.size(F.array_distinct("_words")) / words,
        "_s_repeat_lines": 1 - F.size(F.array_distinct("_lines")) / lines,
        "_s_line_length": F.log1p(F.col("_n") / lines),
        "_s_short_words": F.aggregate("_words", F.lit(0), lambda a, w: a + (F.length(w) <= 3).cast("int")) / words,
    }).drop("_t", "_chars", "_words", "_lines", "_n")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above the threshold?, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, at in self.terms:
            held = held & ((F.col(f"_s_{name}") > at) if above else (F.col(f"_s_{name}") <= at))
        return held.cast("double")


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights; ``intercept`` alone if nothing could be learned."""

    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + rule.column() * F.lit(weight)
        return 1 / (1 + F.exp(-total))


def read_rules(description: str) -> list[Rule]:
    """The distinct paths, inner and whole, of the trees in Spark's description of a forest."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip())
        found = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        while path and (not found or path[-1][0] >= depth):
            if not found and line.lstrip().startswith("Predict"):
                break
            path.pop()
        if found:
            path.append((depth, (STATISTICS[int(found[1])], found[2] == ">", float(found[3]))))
            rules[_tidy(tuple(term for _, term in path))] = None
    return list(rules)


def _tidy(terms: tuple[tuple[str, bool, float], ...]) -> Rule:
    """The tightest threshold for each statistic and side, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, at in terms:
        now = best.get((name, above))
        best[name, above] = at if now is None else (max(now, at) if above else min(now, at))
    return Rule(tuple((n, a, v) for (n, a), v in sorted(best.items())))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int = 5, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Text, label and weight of labelled documents outside the held-out fold 0.

    At most ``class_rows`` rows of each class, the first by a hash of their id;
    the weights restore the shares of the classes. The list of chosen ids is
    bounded by that number, so it is broadcast to the texts.
    """
    known = labels.filter(F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != 0)).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value, n in sorted(counts.items()):
        part = (known.filter(F.col("label") == value).orderBy(hash31(F.lit("train"), F.col("_id")), "_id").limit(class_rows)
                .withColumn("weight", F.lit(max(1.0, n / class_rows))))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return docs.select(F.col("doc_id"), F.col("text"), F.lit(0.0).alias("label"), F.lit(1.0).alias("weight")).limit(0)
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).drop("_id")


def fit_rules(rows: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.001) -> RuleModel:
    """Fit the ensemble to ``rows`` (statistics, label, weight).

    Without rows every score is one half; with one class only it is close to that class.
    """
    # Rows have a place that depends on their values alone, so that a fit can be repeated.
    used = [*[F.col(f"_s_{n}") for n in STATISTICS], F.col("label"), F.col("weight")]
    rows = stored(rows.select(*used).repartition(8, *used).sortWithinPartitions(*used))
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    if len(classes) < 2:
        return RuleModel({0.0: -4.0, 1.0: 4.0}[classes[0]] if classes else 0.0, ())
    assembled = VectorAssembler(inputCols=[f"_s_{n}" for n in STATISTICS], outputCol="_v").transform(rows)
    forest = RandomForestClassifier(featuresCol="_v", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
                                    maxBins=64, minInstancesPerNode=5, seed=7).fit(assembled)
    rules = read_rules(forest.toDebugString)
    if not rules:
        share = rows.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
        return RuleModel(math.log(share / (1 - share)), ())
    held = rows.select("label", "weight", *[r.column().alias(f"_r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_v").transform(held).select("_v", "label", "weight")
    fitted = LogisticRegression(featuresCol="_v", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=penalty,
                                maxIter=60, standardization=False).fit(held)
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5,
                class_rows: int = CLASS_ROWS) -> RuleModel:
    """Learn the rules from the labelled documents outside the held-out fold."""
    return fit_rules(statistics(training_rows(docs, labels, label, folds, class_rows)))


def with_quality(docs: DataFrame, model: RuleModel, score: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; other columns stay.

    Only the text is looked at: nulls count as empty, empty texts get the score
    of their (zero) statistics, repeated rows equal scores.
    """
    return statistics(docs).withColumn(score, model.column()).drop(*[f"_s_{n}" for n in STATISTICS])


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = fit_quality(docs, labels, folds=folds)
    scored = with_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
