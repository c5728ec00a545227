"""Agreement between judges: kappas, intervals, overlap and disagreement mining.

Consensus rows are first laid out one row per trace with one column per judge.
All pair statistics come from small contingency tables counted from there, so
no trace is joined with another row of itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Draws of one replicate that a task makes at a time.
DRAWS = 65_536


def judges_of(consensus: DataFrame) -> list[str]:
    """Names of the judges in a consensus table; each is a column of the tables built from it."""
    return sorted(r[0] for r in consensus.select("judge_model").distinct().collect() if r[0] is not None)


def by_trace(consensus: DataFrame, judges: Sequence[str], values: Sequence[str],
             by: Sequence[str] = ()) -> DataFrame:
    """One row per trace; column ``{value}_{i}`` is the value of judge number i (null if absent).

    Several rows of one judge for one trace give the smallest value.
    """
    cells = [F.min(F.when(F.col("judge_model") == j, F.col(v))).alias(f"{v}_{i}")
             for v in values for i, j in enumerate(judges)]
    return consensus.groupBy("trace_id", *by).agg(*cells)


def _pairs(table: DataFrame, judges: Sequence[str], values: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows per judge pair i<j in the given judge order, with columns a_{value}, b_{value}."""
    pairs = []
    for i, a in enumerate(judges):
        for j in range(i + 1, len(judges)):
            cells = [F.lit(a).alias("judge_a"), F.lit(judges[j]).alias("judge_b")]
            for v in values:
                cells += [F.col(f"{v}_{i}").alias(f"a_{v}"), F.col(f"{v}_{j}").alias(f"b_{v}")]
            pairs.append(F.struct(*cells))
    return table.select(*keep, F.inline(F.array(*pairs)))


def contingency(consensus: DataFrame, judges: Sequence[str] | None = None,
                stages: Sequence[str] = ("j1", "j2"), by: Sequence[str] = ()) -> DataFrame:
    """Counts per judge pair, stage and pair of verdicts, over traces both judges decided."""
    judges = list(judges) if judges else judges_of(consensus)
    table = by_trace(consensus, judges, [f"{s}_consensus" for s in stages], by)
    flat = _pairs(table, judges, [f"{s}_consensus" for s in stages], by)
    staged = flat.select(*by, "judge_a", "judge_b", F.inline(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(f"a_{s}_consensus").alias("a"),
                 F.col(f"b_{s}_consensus").alias("b")) for s in stages])))
    return (staged.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
                  .groupBy(*by, "judge_a", "judge_b", "stage", "a", "b")
                  .agg(F.count(F.lit(1)).alias("cell_n")))


def kappa_from_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cohen's kappa per key from contingency cells ``a, b, cell_n``.

    Null with fewer than two traces, fewer than two categories, or when chance
    agreement is complete.
    """
    margins = cells.select(*keys, F.inline(F.array(
        F.struct(F.col("a").alias("cat"), F.col("cell_n").alias("row_n"), F.lit(0).cast("bigint").alias("col_n"),
                 F.when(F.col("a") == F.col("b"), F.col("cell_n")).otherwise(0).alias("same_n")),
        F.struct(F.col("b").alias("cat"), F.lit(0).cast("bigint").alias("row_n"),
                 F.col("cell_n").alias("col_n"), F.lit(0).cast("bigint").alias("same_n")))))
    per_cat = margins.groupBy(*keys, "cat").agg(F.sum("row_n").alias("row_n"), F.sum("col_n").alias("col_n"),
                                                F.sum("same_n").alias("same_n"))
    total = per_cat.groupBy(*keys).agg(
        F.sum("row_n").alias("n"), F.count(F.lit(1)).alias("categories"), F.sum("same_n").alias("same"),
        F.sum(F.col("row_n").cast("double") * F.col("col_n")).alias("cross"))
    n = F.col("n").cast("double")
    observed, chance = F.col("same") / n, F.col("cross") / (n * n)
    kappa = F.when((F.col("n") >= 2) & (F.col("categories") >= 2) & (F.col("cross") < n * n),
                   F.try_divide(observed - chance, 1 - chance))
    return total.select(*keys, kappa.alias("kappa"), F.col("n"), F.col("categories"))


def pairwise_kappa(consensus: DataFrame, judges: Sequence[str] | None = None,
                   stages: Sequence[str] = ("j1", "j2")) -> DataFrame:
    """Cohen's kappa for every judge pair and stage."""
    cells = contingency(consensus, judges, stages)
    return kappa_from_cells(cells, ["judge_a", "judge_b", "stage"]).drop("categories")


def kappa_by_group(consensus: DataFrame, by: str, judges: Sequence[str] | None = None,
                   stages: Sequence[str] = ("j2",), min_n: int = 5) -> DataFrame:
    """Pairwise kappa inside each group; small and single-category groups are left out."""
    cells = contingency(consensus, judges, stages, [by])
    out = kappa_from_cells(cells, [by, "judge_a", "judge_b", "stage"])
    return out.filter((F.col("n") >= min_n) & (F.col("categories") >= 2)).drop("categories")


def kappa_table(per_group: DataFrame, by: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per-group kappas with one kappa and one n column per judge pair."""
    cells = []
    for a, b in pairs:
        here = (F.col("judge_a") == a) & (F.col("judge_b") == b)
        cells += [F.min(F.when(here, F.col("kappa"))).alias(f"kappa_{a}_{b}"),
                  F.min(F.when(here, F.col("n"))).alias(f"n_{a}_{b}")]
    return per_group.groupBy(by).agg(*cells)


def fleiss_kappa(consensus: DataFrame, judges: Sequence[str] | None = None,
                 stages: Sequence[str] = ("j1", "j2")) -> DataFrame:
    """Fleiss' kappa over three or more judges, on traces that all of them decided."""
    judges = list(judges) if judges else judges_of(consensus)
    if len(judges) < 3:
        raise ValueError("Fleiss' kappa needs at least three judges")
    r = len(judges)
    table = by_trace(consensus, judges, [f"{s}_consensus" for s in stages])
    votes = table.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("stage"),
                 F.array(*[F.col(f"{s}_consensus_{i}") for i in range(r)]).alias("votes")) for s in stages])))
    complete = votes.filter(~F.exists("votes", lambda v: v.isNull()))
    # Sum of squared category counts of a trace = number of ordered vote pairs that agree.
    square = F.aggregate("votes", F.lit(0), lambda acc, v: acc + F.size(
        F.filter("votes", lambda w: w == v)))
    spread = complete.withColumn("square", square).select(
        "stage", "square", F.posexplode("votes").alias("seat", "cat"))
    per_cat = spread.groupBy("stage", "cat").agg(
        F.count(F.lit(1)).alias("n_cat"),
        F.sum(F.when(F.col("seat") == 0, F.col("square")).otherwise(0)).alias("square"))
    total = per_cat.groupBy("stage").agg(
        F.sum("n_cat").alias("n_votes"), F.sum("square").alias("square"),
        F.count(F.lit(1)).alias("categories"),
        F.sum(F.col("n_cat").cast("double") * F.col("n_cat")).alias("sum_sq"))
    n = F.col("n_votes") / r
    observed = (F.col("square") / n - r) / (r * (r - 1.0))
    chance = F.col("sum_sq") / (F.col("n_votes").cast("double") * F.col("n_votes"))
    return total.select("stage", F.try_divide(observed - chance, F.nullif(1 - chance, F.lit(0.0))).alias("kappa"),
                        n.cast("bigint").alias("n"), F.col("categories"))


def acceptance_overlap(consensus: DataFrame, judges: Sequence[str] | None = None) -> DataFrame:
    """How often both, neither or one judge of a pair accepts."""
    judges = list(judges) if judges else judges_of(consensus)
    flat = _pairs(by_trace(consensus, judges, ["accepted"]), judges, ["accepted"])
    a, b = F.col("a_accepted"), F.col("b_accepted")
    counted = flat.filter(a.isNotNull() & b.isNotNull()).groupBy("judge_a", "judge_b").agg(
        F.count_if(a & b).alias("both_accept"), F.count_if(~a & ~b).alias("both_reject"),
        F.count_if(a & ~b).alias("a_only_accept"), F.count_if(~a & b).alias("b_only_accept"),
        F.count(F.lit(1)).alias("n"))
    agree = (F.col("both_accept") + F.col("both_reject")).cast("double")
    return counted.withColumn("agreement_rate", F.try_divide(agree, F.col("n").cast("double")))


def label_agreement(consensus: DataFrame, judges: Sequence[str] | None = None) -> DataFrame:
    """On traces both judges accept: how often their hard/soft labels match."""
    judges = list(judges) if judges else judges_of(consensus)
    flat = _pairs(by_trace(consensus, judges, ["accepted", "hard_soft"]), judges, ["accepted", "hard_soft"])
    usable = (F.coalesce(F.col("a_accepted") & F.col("b_accepted"), F.lit(False))
              & F.col("a_hard_soft").isNotNull() & F.col("b_hard_soft").isNotNull())
    out = flat.groupBy("judge_a", "judge_b").agg(
        F.count_if(usable).alias("n"),
        F.count_if(usable & (F.col("a_hard_soft") == F.col("b_hard_soft"))).alias("agree_count"))
    return out.withColumn("agree_rate",
                          F.try_divide(F.col("agree_count").cast("double"), F.col("n").cast("double")))


def disagreements(consensus: DataFrame, judges: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    """Traces with the most distinct second-stage verdicts among judges (a top-n report)."""
    judges = list(judges) if judges else judges_of(consensus)
    table = by_trace(consensus, judges, ["j2_consensus"])
    named = table.select("trace_id", *[F.col(f"j2_consensus_{i}").alias(j) for i, j in enumerate(judges)])
    full = named.dropna(subset=list(judges))
    seen = F.size(F.array_distinct(F.array(*[F.col(j) for j in judges]))).cast("bigint")
    return full.withColumn("diversity", seen).orderBy(F.desc("diversity"), "trace_id").limit(top_n)


def disagreement_examples(top: DataFrame, judgments: DataFrame, snippet: int = 400) -> DataFrame:
    """All verdicts of the reported traces, each with the first run's reasoning as a snippet.

    ``top`` is the bounded report of :func:`disagreements`. Verdicts stay one
    row each, in run order.
    """
    chosen = judgments.join(F.broadcast(top.select("trace_id")), "trace_id", "left_semi")
    why = F.coalesce(F.nullif(F.col("reasoning"), F.lit("")), F.col("evidence"))
    flat = F.replace(F.trim(why), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(flat) > snippet, F.concat(F.substring(flat, 1, snippet), F.lit("…"))).otherwise(flat)
    first = chosen.groupBy("trace_id", "judge_model", "stage").agg(
        F.min("run_idx").alias("run_idx"), F.min_by(cut, F.col("run_idx")).alias("example"))
    return chosen.select("trace_id", "judge_model", "stage", "run_idx", "judgment").join(
        first, ["trace_id", "judge_model", "stage", "run_idx"], "left")


def kappa_bootstrap(consensus: DataFrame, judges: Sequence[str] | None = None,
                    stages: Sequence[str] = ("j1", "j2"), replicates: int = 1000, seed: int = 42,
                    method: str = "multinomial") -> DataFrame:
    """Kappa with a 95 % bootstrap interval (2.5 and 97.5 percentiles, linear).

    Drawing n traces with replacement and counting their verdict pairs is one
    multinomial draw over the contingency cells, so replicates never touch the
    traces again. ``multinomial`` draws the cell counts with NumPy, one seeded
    generator per replicate; ``index`` draws every trace index from an md5, once for
    all pairs, and looks up the cell it falls in, for checking against SQL.
    """
    keys = ["judge_a", "judge_b", "stage"]
    cells = contingency(consensus, judges, stages)
    point = kappa_from_cells(cells, keys)
    draws = (_index_draws if method == "index" else _multinomial_draws)(cells, keys, replicates, seed)
    boot = kappa_from_cells(draws, [*keys, "replicate"])
    bounds = boot.groupBy(*keys).agg(
        F.percentile("kappa", F.lit(0.025)).alias("ci_low"), F.percentile("kappa", F.lit(0.975)).alias("ci_high"),
        F.count("kappa").alias("replicates_used"))
    usable = F.col("kappa").isNotNull()
    return point.join(bounds, keys, "left").select(
        *keys, "kappa", F.when(usable, F.col("ci_low")).alias("ci_low"),
        F.when(usable, F.col("ci_high")).alias("ci_high"),
        F.coalesce("replicates_used", F.lit(0)).cast("bigint").alias("replicates_used"), "n")


def _cell_lists(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of one pair and stage as a sorted list (at most verdicts squared entries)."""
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b", "cell_n"))).alias("cells"),
                                    F.sum("cell_n").alias("n"))


def _index_draws(cells: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Counts per key, replicate and cell of n drawn trace indexes.

    A draw's md5 is the same for every pair and stage, so a task makes it once and looks it up in
    all their lists. The number of tasks is given: small rows that make long work must not be joined into one task.
    """
    spark = cells.sparkSession
    lists = F.array_sort(F.collect_list(F.struct(*keys, "cells", "n")))
    every = _cell_lists(cells, keys).agg(lists.alias("lists"))
    plain = F.transform("lists", lambda one: F.named_struct(F.lit("n"), one["n"], F.lit("sizes"), F.transform(one["cells"], lambda c: c["cell_n"])))
    most = F.array_max(F.transform("lists", lambda one: one["n"]))
    pieces = (every.select(plain.alias("lists"), most.alias("most"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
              .select("lists", "most", "replicate", F.explode(F.expr(f"sequence(0L, (most - 1) div {DRAWS})")).alias("chunk"))
              .repartition(4 * spark.sparkContext.defaultParallelism, "replicate", "chunk"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _count_draws(row, seed)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=made)

    made = pa.schema([("place", pa.int32()), ("replicate", pa.int32()), ("hit", pa.int32()), ("n", pa.int64())])
    counted = (pieces.mapInArrow(count, "place int, replicate int, hit int, n bigint")
               .groupBy("place", "replicate", "hit").agg(F.sum("n").alias("cell_n")))
    named = every.select(F.posexplode("lists").alias("place", "one")).select("place", "one.*").select(*keys, "place", F.posexplode("cells").alias("hit", "cell"))
    return counted.join(F.broadcast(named), ["place", "hit"]).select(*keys, "replicate", "cell.a", "cell.b", "cell_n")


def _count_draws(row: dict, seed: int) -> list[tuple[int, int, int, int]]:
    """(list, replicate, cell, draws in it) of one chunk of a replicate's draws."""
    low = row["chunk"] * DRAWS
    start = f"{seed}:{row['replicate']}:".encode()
    heads = b"".join([md5(start + b"%d" % i, usedforsecurity=False).digest()[:4] for i in range(low, min(row["most"], low + DRAWS))])
    drawn = np.frombuffer(heads, dtype=">u4").astype(np.int64)
    out = []
    for place, one in enumerate(row["lists"]):
        mine = drawn[:max(0, one["n"] - low)] % one["n"]
        hits = np.bincount(np.searchsorted(np.cumsum(one["sizes"]), mine, side="right"), minlength=len(one["sizes"]))
        out += [(place, row["replicate"], cell, int(n)) for cell, n in enumerate(hits) if n]
    return out


def _multinomial_draws(cells: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    lists = _cell_lists(cells, keys).select(
        *keys, "n", F.transform("cells", lambda c: c["a"]).alias("a"),
        F.transform("cells", lambda c: c["b"]).alias("b"), F.transform("cells", lambda c: c["cell_n"]).alias("m"),
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def draw(n: pd.Series, m: pd.Series, replicate: pd.Series, salt: pd.Series) -> pd.Series:
        out = []
        for size, counts, rep, extra in zip(n, m, replicate, salt):
            rng = np.random.default_rng([seed, int(rep), int(extra)])
            weights = np.asarray(counts, dtype=float)
            out.append(rng.multinomial(int(size), weights / weights.sum()).tolist())
        return pd.Series(out)

    salt = F.pmod(F.xxhash64(*keys), F.lit(2 ** 31))
    drawn = lists.withColumn("d", draw(F.col("n"), F.col("m"), F.col("replicate"), salt))
    zipped = F.arrays_zip(F.col("a"), F.col("b"), F.col("d").alias("cell_n"))
    return (drawn.select(*keys, "replicate", F.inline(zipped)).toDF(*keys, "replicate", "a", "b", "cell_n")
                 .filter(F.col("cell_n") > 0))
