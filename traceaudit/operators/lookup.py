"""Joins of a large table with a keyed table whose keys are hot on the large side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 64
HOT_SHARE = 1_000


def lookup_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left or inner join of ``fact`` with ``dim`` on the columns ``on``.

    The keyed table is broadcast if it has at most ``broadcast_bytes``; beyond
    that :func:`hot_cold_join` takes over.
    """
    on = list(on)
    if size_of(dim, broadcast_bytes) <= broadcast_bytes:
        return fact.join(F.broadcast(dim), on, how)
    return hot_cold_join(fact, dim, on, how)


def size_of(df: DataFrame, enough: int) -> int:
    """Bytes of a table: the planner's bound if that is at most ``enough``, else the measured size of its values."""
    bound = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if bound <= enough:
        return bound
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if kind.startswith(("array", "map", "struct")) else F.col(c).cast("string")), F.lit(0))
            for c, kind in df.dtypes]
    row = wide[0]
    for w in wide[1:]:
        row = row + w
    return df.agg(F.sum(row + 16 * len(wide))).first()[0] or 0


def hot_cold_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
                  share: int = HOT_SHARE) -> DataFrame:
    """Join in which no key with more than one ``share``-th of the fact rows is shuffled to one task.

    There are fewer than ``share`` such keys, found by one combinable count. Their
    rows are dealt over ``SALTS`` parts, each of which gets a copy of the key's
    rows of ``dim``, of which there may be several. All other keys take an
    ordinary shuffle join. Rows with a null key match nothing and are not
    shuffled at all.
    """
    if how not in ("left", "inner"):
        raise ValueError("left and inner joins only")
    on = list(on)
    whole = reduce(lambda a, c: a & F.col(c).isNotNull(), on, F.lit(True))
    keyed = fact.filter(whole)
    counts = keyed.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = keyed.agg(F.count(F.lit(1))).scalar()
    hot = F.broadcast(counts.filter(F.col("__n") * share > total).select(*on))      # fewer than `share` rows
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = dim.join(hot, on, "left_semi").withColumn("__salt", salt)
    dealt = keyed.join(hot, on, "left_semi").withColumn("__salt", F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS)).cast("int"))
    out = dealt.join(copies, [*on, "__salt"], how).drop("__salt").unionByName(keyed.join(hot, on, "left_anti").join(dim, on, how))
    if how == "inner":
        return out
    rest = fact.filter(~whole).select(*[F.col(c) if c in fact.columns else F.lit(None).cast(dim.schema[c].dataType).alias(c)
                                                          for c in out.columns])
    return out.unionByName(rest)
