"""Mixing sources to target weights.

Every document gets a key drawn by a hash; within its source the documents are
put in the order of that key, distributed prefix sums of the sizes are taken,
and the source is read in this order, again from the start if needed, until its
budget is reached exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import WORD, hash31, stored
from traceaudit.operators.ranking import globally_ranked

# Rows of a source that one sort range holds on average.
RANGE_ROWS = 2_000
KEY_SPAN = 1 << 31


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn_key(seed: str) -> Column:
    """The key of a document in the order of its source: drawn by a hash of seed, id and text."""
    return hash31(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3) -> DataFrame:
    """Size, number of documents and target of each source.

    ``sizes`` has source and size. Sources in the order of their code points
    (null last) get the weights in turn; together the targets are the size of
    the whole corpus. No target exceeds ``max_repeats`` times the source's size;
    what is left over is shared again by weight among the others, until none is
    above. Only sums over sources come to the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                             F.count(F.lit(1)).alias("source_rows"))
    placed = globally_ranked(per_source, [F.col("source").asc_nulls_last()], "_place")
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    sources = stored(placed.select(
        "source", "source_size", "source_rows",
        F.element_at(ladder, (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(max_repeats)).alias("most")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # A source is full once its share of what the full ones leave would exceed what it may give.
        capped = F.col("most") < F.lit(level) * F.col("weight") if full >= 0 else F.lit(False)
        given, open_weight, count = sources.agg(
            F.sum(F.when(capped, F.col("most")).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
            F.sum(F.when(capped, 1).otherwise(0))).first()
        if count is None or count == full:
            break
        full = count
        level = (total - given) / open_weight if open_weight else level
    return sources.select("source", "source_size", "source_rows",
                          F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, weights: Sequence[float] = (1, 2, 3), max_repeats: float = 3,
        seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """What the mix takes of each document.

    ``docs`` has doc_id, text and source; ``size`` is an expression over them.
    Returns one row per row of ``docs``: doc_id, source, size, source_size,
    target, taken (repeats counted), _key. The same rows give the same result,
    whatever their order or number of files.

    Each source is cut into ranges of its keys, as many as its rows need, so a
    source with any share of the corpus is sorted by many tasks; one small table
    carries the sums from range to range.

    Null ids and texts are ordinary values, a null source is a source of its
    own. Repeated rows share a key; each is read in turn. A source without words
    has the target 0 and nothing is taken. An empty table gives no rows.
    """
    rows = stored(docs.select(
        F.col("doc_id"), F.col("source"), size.cast("long").alias("size"),
        drawn_key(seed).alias("_key")))
    targets = stored(source_targets(rows, weights, max_repeats))
    ranged = (rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
              .withColumn("_range", F.floor(F.col("_key") * F.ceil(F.col("source_rows") / range_rows) / KEY_SPAN)))
    inside = (Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = stored(ranged.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0))))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (local.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
            .select(F.col("source").alias("_source"), F.col("_range").alias("_at"),
                    F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried")))
    joined = local.join(sums, local["source"].eqNullSafe(sums["_source"]) & (local["_range"] == sums["_at"]))
    before = F.col("_carried") + F.col("_local")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - before))
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (epochs * F.col("size") + part).cast("long").alias("taken"), "_key")


def mixed_documents(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The rows of ``docs`` as the mix reads them, with the columns of ``docs``.

    A row comes once per epoch that takes it; the document at the budget's edge
    comes if at least half of it fits. Rows without words are not part of any
    budget and stay once. Since a source is read in the order of its keys, its
    last row in that order tells for every other row whether it is taken, so the
    texts meet one row per source and are not shuffled by document.
    """
    names = docs.columns
    plan = mix(docs, size, **options)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    extra = F.col("taken") - epochs * F.col("size")
    place = F.struct(F.col("_key"), F.col("doc_id"), F.col("size"))
    last = plan.groupBy("source").agg(F.max(epochs).alias("_epochs"), F.max(F.when((F.col("size") > 0) & (2 * extra >= F.col("size")), place)).alias("_last"))
    last = stored(last.withColumnRenamed("source", "_source"))
    keyed = docs.select("*", drawn_key(options.get("seed", "mix")).alias("_key"), size.cast("long").alias("_size"))
    met = keyed.join(last, keyed["source"].eqNullSafe(last["_source"]))
    taken = F.coalesce((F.struct(F.col("_key"), F.col("doc_id"), F.col("_size")) <= F.col("_last")).cast("int"), F.lit(0))
    times = F.when(F.col("_size") > 0, F.col("_epochs") + taken).otherwise(1).cast("int")
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*names)
