"""Deterministic splits and samples: rows are shuffled by the md5 of seed and id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.functions.text import hex_bucket, shuffle_key
from traceaudit.operators.ranking import ranked
from traceaudit.session import cut_lineage


def stratified_split(rows: DataFrame, strata: Sequence[str], id_column: str, seed: int = 42,
                     train: float = 0.70, val: float = 0.15, small_cells_to_train: int = 0) -> DataFrame:
    """Add a ``split`` column: train, val or test, per stratum.

    Sizes are rounded half to even; every stratum gets at least one training
    and, where it can, one validation row; test takes the rest. Strata with
    fewer than ``small_cells_to_train`` rows go to train whole.
    """
    keyed = rows.withColumn("__key", shuffle_key(seed, F.col(id_column)))
    placed = ranked(keyed, strata, ["__key", id_column], hex_bucket(F.col("__key")), "__pos", "__n")
    n = F.col("__n")
    n_train = F.greatest(F.lit(1), F.rint(n * F.lit(train)).cast("bigint"))
    n_val = F.greatest(F.lit(1), F.rint(n * F.lit(val)).cast("bigint"))
    n_val = F.when(n - n_train - n_val < 0, F.greatest(F.lit(0), n - n_train - 1)).otherwise(n_val)
    split = (F.when(F.col("__pos") <= n_train, "train")
              .when(F.col("__pos") <= n_train + n_val, "val").otherwise("test"))
    if small_cells_to_train:
        split = F.when(n < small_cells_to_train, "train").otherwise(split)
    return placed.withColumn("split", split).drop("__key", "__pos", "__n")


def _top(rows: DataFrame, groups: Sequence[str], key: str, id_column: str, limit: int) -> DataFrame:
    """First ``limit`` rows per group by key; Spark cuts each map task to ``limit`` rows per group first."""
    w = Window.partitionBy(*groups).orderBy(key, id_column)
    return rows.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= limit)


def balanced_sample(rows: DataFrame, group: str, label: str, id_column: str, target: int = 10,
                    seed: int = 42, labels: tuple[str, str] = ("hard", "soft")) -> DataFrame:
    """Up to ``target`` rows per group, half of them with the first label if available.

    Rows with neither label are left out. A shortage of the second label is
    filled with more of the first.
    """
    keyed = rows.filter(F.col(label).isin(*labels)).withColumn("__key", shuffle_key(seed, F.col(id_column)))
    best = _top(keyed, [group, label], "__key", id_column, target)
    # At most `target` rows per (group, label) are left, so the counts below are capped, not sampled.
    sizes = best.groupBy(group).agg(F.count_if(F.col(label) == labels[0]).alias("__first"),
                                    F.count_if(F.col(label) == labels[1]).alias("__second"))
    half = F.least(F.lit(target // 2), F.col("__first"))
    take_second = F.least(F.lit(target) - half, F.col("__second"))
    take_first = F.least(F.col("__first"), F.lit(target) - take_second)
    quota = F.when(F.col(label) == labels[0], take_first).otherwise(take_second)
    return best.join(sizes, group).filter(F.col("__rank") <= quota).drop("__key", "__rank", "__first", "__second")


def rejected_sample(rows: DataFrame, reason: str, id_column: str, total: int = 30, seed: int = 42) -> DataFrame:
    """``total`` rows spread over the reasons, topped up from what is left.

    Every reason gives ``max(1, total div reasons)`` rows; the rest of the
    total comes from the pooled remainder in shuffle order.
    """
    keyed = (rows.withColumn(reason, F.coalesce(F.col(reason), F.lit("unknown")))
                 .withColumn("__key", shuffle_key(seed, F.col(id_column))))
    best = cut_lineage(_top(keyed, [reason], "__key", id_column, total))        # at most `total` rows for each reason
    per_reason = best.groupBy(reason).agg(F.count(F.lit(1)).alias("__n"))
    share = per_reason.agg(F.greatest(F.lit(1).cast("bigint"), F.expr(f"{total} div count(1)"))).scalar()
    spare = per_reason.agg(F.lit(total) - F.sum(F.least(F.col("__n"), share))).scalar()
    first = best.filter(F.col("__rank") <= share)
    pool = best.filter(F.col("__rank") > share).orderBy("__key", id_column).limit(total)
    w = Window.orderBy("__key", id_column)                  # at most `total` rows
    extra = pool.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= spare)
    return first.unionByName(extra).drop("__key", "__rank")


def control_sample(rows: DataFrame, id_column: str, n: int = 10, seed: int = 42) -> DataFrame:
    """The first ``n`` rows in shuffle order."""
    keyed = rows.withColumn("__key", shuffle_key(seed, F.col(id_column)))
    return keyed.orderBy("__key", id_column).limit(n).drop("__key")


def combine_strata(parts: Sequence[tuple[str, DataFrame]], id_column: str) -> DataFrame:
    """Union of the parts without repeated ids; the earlier part keeps the row."""
    tagged = [df.select(F.col(id_column), F.lit(i).alias("priority"), F.lit(name).alias("part"))
              for i, (name, df) in enumerate(parts)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    return union.groupBy(id_column).agg(F.min_by("part", "priority").alias("part"))


def rows_of_split(rows: DataFrame, splits: DataFrame, key: str = "log_filename", split: str = "test") -> DataFrame:
    """Rows whose key belongs to one part of a stored split."""
    return rows.join(splits.filter(F.col("split") == split).select(key), key, "left_semi")


def stratum_label(category: Column, violation: Column, accepted: Column, reason: Column) -> Column:
    """Name of the stratum a sampled trace came from."""
    return (F.when(category == "control", "clean_control")
             .when(accepted, F.concat(F.lit("accepted/"), violation))
             .when(~accepted, F.concat(F.lit("rejected/"), F.coalesce(reason, F.lit("unknown"))))
             .otherwise("unknown"))


def stratified_sample(traces: DataFrame, labels: DataFrame, controls: DataFrame | None = None,
                      active: Sequence[str] | None = None, per_type: int = 10, rejected: int = 30,
                      clean: int = 10, seed: int = 42) -> DataFrame:
    """Sample manifest: accepted traces balanced per type, rejected per reason, clean controls.

    ``traces`` holds ``run_id, task_id, violation_id, violation_category,
    target_agent, designed_hard_soft``; ``labels`` holds ``run_id, accepted,
    precheck_passed, final_label, rejection_reason``.
    """
    known = [c for c in labels.columns if c != "run_id"]
    full = traces.join(labels, "run_id", "left").withColumn("__control", F.lit(False))
    if controls is not None:
        for name in known:
            if name not in controls.columns:
                controls = controls.withColumn(name, F.lit(None).cast(labels.schema[name].dataType))
        full = full.unionByName(controls.withColumn("__control", F.lit(True)), allowMissingColumns=True)
    rows = full.select(
        "run_id", "task_id", "violation_id", "target_agent", "designed_hard_soft",
        stratum_label(F.col("violation_category"), F.col("violation_id"), F.col("accepted"), F.col("rejection_reason")).alias("stratum"),
        "accepted", "final_label", "rejection_reason", "precheck_passed", "__control", shuffle_key(seed, F.col("run_id")).alias("__key"))
    typed = F.col("violation_id").isin(*active) if active else F.lit(True)
    # Each row is offered to the one stratum that it may stand for; that stratum's smallest keys are all that is kept of it.
    part = (F.when(F.col("__control"), "control")
            .when(F.col("accepted") & typed & F.col("final_label").isin("hard", "soft"), "accepted")
            .when(~F.col("accepted") & F.col("precheck_passed"), "rejected"))
    cell = F.when(part == "accepted", F.concat_ws("|", "violation_id", "final_label")).when(part == "rejected", F.coalesce("rejection_reason", F.lit("unknown")))
    offered = rows.withColumns({"__part": part, "__cell": F.coalesce(cell, F.lit(""))}).filter("__part is not null")
    best = _smallest(offered, ["__part", "__cell"], max(per_type, rejected, clean))
    return _within_quotas(best, per_type, rejected, clean).select(
        "run_id", "task_id", "violation_id", "target_agent", "designed_hard_soft", "stratum", "accepted", "final_label", "rejection_reason")


def _smallest(rows: DataFrame, groups: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` rows of each group with the smallest keys, with their ``__rank``.

    Each map task keeps as many before the shuffle, which makes it a mergeable
    sketch of the smallest keys of all strata in one pass.
    """
    order = Window.partitionBy(*groups).orderBy("__key", "run_id")
    return rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= limit)


def _within_quotas(best: DataFrame, per_type: int, rejected: int, clean: int) -> DataFrame:
    """What the quotas leave of the strata's smallest rows; all windows here run over those few rows."""
    of_type = Window.partitionBy("__part", F.when(F.col("__part") == "accepted", F.col("violation_id")))
    capped = F.col("__rank") <= per_type
    hard, soft = (F.count_if(capped & (F.col("final_label") == label)).over(of_type) for label in ("hard", "soft"))
    take_hard = F.least(F.lit(per_type // 2), hard)
    take_soft = F.least(F.lit(per_type) - take_hard, soft)
    take_hard = F.least(F.lit(per_type) - take_soft, hard)
    in_part = Window.partitionBy("__part")
    reasons = F.size(F.collect_set("__cell").over(in_part))
    share = F.greatest(F.lit(1), F.floor(F.lit(rejected) / reasons))
    sized = best.withColumns({"__hard": take_hard, "__soft": take_soft, "__share": share})
    sized = sized.withColumn("__spare", F.lit(rejected) - F.count_if(F.col("__rank") <= F.col("__share")).over(in_part))
    # What a reason has beyond its share stands in one line, in the order of the keys, for what is left of the total.
    line = Window.partitionBy("__part", F.col("__rank") > F.col("__share")).orderBy("__key", "run_id")
    sized = sized.withColumn("__place", F.row_number().over(line))
    kept = (F.when(F.col("__part") == "control", F.col("__rank") <= clean)
            .when(F.col("__part") == "accepted", F.col("__rank") <= F.when(F.col("final_label") == "hard", F.col("__hard")).otherwise(F.col("__soft")))
            .otherwise((F.col("__rank") <= rejected) & ((F.col("__rank") <= F.col("__share")) | (F.col("__place") <= F.col("__spare")))))
    chosen = sized.filter(kept)
    # A run that several parts chose stands for the first of them.
    first = F.when(F.col("__part") == "accepted", 0).when(F.col("__part") == "rejected", 1).otherwise(2)
    return chosen.withColumn("__first", F.min(first).over(Window.partitionBy("run_id"))).filter(first == F.col("__first"))


def assign_controls(clean: DataFrame, targets: Sequence[tuple[str, str]], id_column: str = "run_id",
                    prompts: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Give every clean trace one (violation, agent) target, chosen by the md5 of id and target.

    The target list is a constant; the smallest hash wins inside the row, so
    nothing is multiplied or shuffled. ``prompts`` (agent, prompt) adds the
    original prompt of the target agent and restricts the targets to its agents.
    """
    if prompts is not None:
        asked = sorted({agent for _, agent in targets})
        agents = {r[0] for r in prompts.filter(F.col("agent").isin(asked)).select("agent").distinct().collect()}
        targets = [t for t in targets if t[1] in agents]
    rid = F.col(id_column).cast("string")
    options = F.array(*[F.struct(shuffle_key(seed, rid, F.lit(v), F.lit(a)).alias("k"),
                                 F.lit(v).alias("violation_id"), F.lit(a).alias("target_agent"))
                        for v, a in targets])
    best = F.array_min(options)
    kept = [c for c in clean.columns if c not in ("violation_id", "target_agent", id_column)]
    staged = clean.withColumn("__t", best)
    out = staged.select(
        F.concat(rid, F.lit("::ctrl::"), F.col("__t.violation_id"), F.lit("::"),
                 F.col("__t.target_agent")).alias(id_column),
        F.col("__t.violation_id").alias("violation_id"), F.col("__t.target_agent").alias("target_agent"),
        *[c for c in kept if c not in ("violation_category", "violation_name", "designed_hard_soft")],
        F.lit("control").alias("violation_category"), F.lit("clean_control").alias("violation_name"),
        F.lit("none").alias("designed_hard_soft"))
    if prompts is None:
        return out
    from traceaudit.operators.lookup import lookup_join
    joined = lookup_join(out, prompts.select(F.col("agent").alias("target_agent"),
                                             F.col("prompt").alias("original_system_prompt")), ["target_agent"])
    if "modified_system_prompt" not in joined.columns:
        return joined
    # A control without a prompt of its own shows the original one.
    own = F.nullif("modified_system_prompt", F.lit(""))
    return joined.withColumn("modified_system_prompt", F.coalesce(own, "original_system_prompt"))
