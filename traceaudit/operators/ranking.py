"""Positions, running totals and first/last rows that survive hot keys.

A plain window sorts all rows of a key inside one task. Here every key is cut
into buckets that are monotone in the sort order: rows are windowed inside
``(key, bucket)`` and a small per-bucket table carries the offset from one
bucket to the next. The caller picks a bucket expression that bounds the rows
of one bucket, such as ``span_idx div 65536`` or a hex prefix of an md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.session import cut_lineage


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality over pairs of column names."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def _with_bucket_totals(df: DataFrame, keys: Sequence[str], totals: Sequence[Column],
                        carries: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """Join each row to values carried from the earlier buckets of its key."""
    per_bucket = df.groupBy(*keys, "__b").agg(*totals)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    over_key = Window.partitionBy(*keys)
    side = per_bucket.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__b").alias("__kb"),
        *[expr.over(before).alias(name) for name, expr in carries.items()],
        *[expr.over(over_key).alias(name) for name, expr in whole.items()],
    )
    pairs = [(k, f"__k{i}") for i, k in enumerate(keys)] + [("__b", "__kb")]
    joined = df.join(side, same_keys(df, side, pairs), "inner")
    return joined.drop(*[p[1] for p in pairs])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
           position: str = "pos", total: str | None = None) -> DataFrame:
    """1-based position of each row inside its key, and optionally the key's row count."""
    base = df.withColumn("__b", bucket)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    local = base.withColumn("__at", F.row_number().over(inside))
    whole = {total: F.sum("__n")} if total else {}
    out = _with_bucket_totals(local, keys, [F.count(F.lit(1)).alias("__n")],
                              {"__off": F.sum("__n")}, whole)
    return (out.withColumn(position, F.col("__at") + F.coalesce(F.col("__off"), F.lit(0)))
               .drop("__b", "__at", "__off"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key (exclusive)."""
    base = df.withColumn("__b", bucket).withColumn("__v", value)
    inside = (Window.partitionBy(*keys, "__b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = base.withColumn("__run", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    out = _with_bucket_totals(local, keys, [F.sum("__v").alias("__s")], {"__off": F.sum("__s")}, {})
    return (out.withColumn(name, F.col("__run") + F.coalesce(F.col("__off"), F.lit(0)))
               .drop("__b", "__v", "__run", "__off"))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
                value: Column, name: str) -> DataFrame:
    """Largest ``value`` among the earlier rows of the key (exclusive, null at the start)."""
    base = df.withColumn("__b", bucket).withColumn("__v", value)
    inside = (Window.partitionBy(*keys, "__b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = base.withColumn("__run", F.max("__v").over(inside))
    out = _with_bucket_totals(local, keys, [F.max("__v").alias("__s")], {"__off": F.max("__s")}, {})
    return (out.withColumn(name, F.greatest("__run", "__off"))
               .drop("__b", "__v", "__run", "__off"))


def globally_ranked(df: DataFrame, order: Sequence[Column | str], position: str = "pos",
                    total: str | None = None) -> DataFrame:
    """1-based position of each row in the whole table.

    A range-partitioned sort is written once through a checkpoint, so that the
    row counts per partition and the rows themselves come from one layout; the
    offsets table has one row per partition.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    placed = (placed.withColumn("__pid", F.shiftright("__m", 33))
                    .withColumn("__in", F.col("__m") - F.shiftleft(F.shiftright("__m", 33), 33)))
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = counts.select(F.col("__pid"),
                            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"),
                            F.sum("__n").over(everything).alias("__all"))
    out = placed.join(F.broadcast(offsets), "__pid")   # one row per sort partition
    out = out.withColumn(position, F.col("__in") + F.col("__off") + 1)
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__m", "__pid", "__in", "__off", "__all")


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
               columns: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: the row with the smallest order, found by a combinable aggregate."""
    return _pick(df, keys, F.min_by(F.struct(*columns), F.struct(*order)), extra)


def pick_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
              columns: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: the row with the largest order, found by a combinable aggregate."""
    return _pick(df, keys, F.max_by(F.struct(*columns), F.struct(*order)), extra)


def _pick(df: DataFrame, keys: Sequence[str], chosen: Column,
          extra: dict[str, Column] | None) -> DataFrame:
    extra = extra or {}
    grouped = df.groupBy(*keys).agg(chosen.alias("__row"),
                                    *[c.alias(n) for n, c in extra.items()])
    return grouped.select(*keys, "__row.*", *extra)
