"""Sharding by a k-d tree over the documents' metadata.

The corpus is cut again and again at a weighted median of the dimension in
which the node at hand is widest, until there are as many leaves as shards.
Medians come from distributed histograms that are refined around the cut, so no
row moves while the tree grows, and the finished tree is a column expression of
a row's own values: a shard is known without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import hash31, stored

# Bins of a histogram and the share of a leaf to which a cut is made exact.
BINS = 1 << 12
SLACK = 0.001
SPAN = 1 << 31
SLOT_ROWS = 20_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def text_crc(text: Column) -> Column:
    """crc32 of the UTF-8 text; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Node:
    """Rows whose position in ``dimension`` is at most ``cut`` go to the first ``left`` leaves of this node."""

    first: int
    leaves: int
    dimension: int
    cut: int
    left: int


def positions(dimensions: Sequence[Column], tie: Column) -> list[Column]:
    """Dimensions with values from 0 to 2**31-1 as positions in which hardly two rows are equal.

    Equal values are ordered by ``tie``, so that a value held by a third of all rows can be cut as well.
    """
    return [(d.cast("long") * F.lit(SPAN) + tie).alias(f"_d{i}") for i, d in enumerate(dimensions)]


def _cuts(rows: DataFrame, wide: dict[int, tuple[int, int, int, float]], tolerance: float) -> dict[int, int]:
    """For each open node the last position of its first part.

    ``wide`` maps a node to (dimension, lowest, highest position, bytes wanted in the first part).
    Each round counts the bytes in equal bins of the interval that still holds the cut.
    """
    open_at = {n: [d, lo, hi, want] for n, (d, lo, hi, want) in wide.items()}
    done: dict[int, int] = {}
    while open_at:
        spec = [(n, d, lo, hi, max(1, -(-(hi - lo + 1) // BINS))) for n, (d, lo, hi, _) in open_at.items()]
        pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for s in spec for x in (s[0], s[i])]), F.col("_node"))
        at = F.expr("CASE " + " ".join(f"WHEN _node = {s[0]} THEN _d{s[1]}" for s in spec) + " END")
        ours = rows.filter(F.col("_node").isin([s[0] for s in spec])).select(
            "_node", "_size", at.alias("_at"), pick(2).alias("_lo"), pick(3).alias("_hi"), pick(4).alias("_step"))
        bins = (ours.filter(F.col("_at").between(F.col("_lo"), F.col("_hi")))
                .groupBy("_node", F.expr("(_at - _lo) div _step").alias("_bin"))
                .agg(F.sum("_size").alias("_bytes"), F.min("_at").alias("_low"), F.max("_at").alias("_top")))
        upto = Window.partitionBy("_node").orderBy("_bin")
        run = bins.withColumn("_sum", F.sum("_bytes").over(upto))
        want = F.element_at(F.create_map(*[F.lit(x) for n, v in open_at.items() for x in (n, float(v[3]))]), F.col("_node"))
        # The bin in which the sum passes what is wanted: one row for each node.
        found = (run.filter((F.col("_sum") >= want) & (F.col("_sum") - F.col("_bytes") < want))
                 .select("_node", "_bin", "_bytes", "_sum", "_low", "_top").collect())
        steps = {s[0]: s[4] for s in spec}
        hit = {r["_node"]: r for r in found}
        for n in list(open_at):
            d, lo, hi, wanted = open_at[n]
            if n not in hit:                      # nothing wanted on this side
                done[n] = lo - 1 if wanted <= 0 else hi
                del open_at[n]
                continue
            r = hit[n]
            below = r["_sum"] - r["_bytes"]
            start = lo + int(r["_bin"]) * steps[n]
            if r["_low"] == r["_top"] or r["_bytes"] <= tolerance:
                near_top = abs(r["_sum"] - wanted) <= abs(wanted - below)
                done[n] = int(r["_top"]) if near_top else start - 1
                del open_at[n]
            else:
                open_at[n] = [d, r["_low"], r["_top"], wanted - below]
    return done


def grow_tree(rows: DataFrame, dimensions: int, shards: int, slack: float = SLACK) -> list[list[Node]]:
    """Levels of the tree over ``rows`` (``_size``, ``_d0`` ... ``_dn``), each a list of cut nodes.

    A node is named by its first leaf. A node of k leaves is cut so that its
    parts hold floor(k/2) and the rest of the leaves, with bytes in proportion.
    What comes to the driver is a few numbers per node.
    """
    levels: list[list[Node]] = []
    whole = rows.agg(F.sum("_size"), *[F.max(f"_d{i}") for i in range(dimensions)],
                     *[F.min(f"_d{i}") for i in range(dimensions)]).first()
    if whole[0] is None:
        return levels
    tolerance = slack * whole[0] / shards
    spread = [max(1, whole[1 + i] - whole[1 + dimensions + i]) for i in range(dimensions)]
    leaves = {0: shards}
    while any(k > 1 for k in leaves.values()):
        placed = rows.withColumn("_node", leaf_column(levels, [F.col(f"_d{i}") for i in range(dimensions)]))
        placed = placed.filter(F.col("_node").isin([n for n, k in leaves.items() if k > 1]))
        stats = {r["_node"]: r for r in placed.groupBy("_node").agg(
            F.sum("_size").alias("bytes"), *[F.min(f"_d{i}").alias(f"lo{i}") for i in range(dimensions)],
            *[F.max(f"_d{i}").alias(f"hi{i}") for i in range(dimensions)]).collect()}
        wide = {}
        for n, r in stats.items():
            d = max(range(dimensions), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / spread[i], -i))
            wide[n] = (d, r[f"lo{d}"], r[f"hi{d}"], r["bytes"] * (leaves[n] // 2) / leaves[n])
        cuts = _cuts(placed, wide, tolerance)
        level = [Node(n, leaves[n], wide[n][0], cuts[n], leaves[n] // 2) for n in sorted(cuts)]
        levels.append(level)
        for node in level:
            leaves[node.first] = node.left
            leaves[node.first + node.left] = node.leaves - node.left
        for n in [n for n, k in leaves.items() if k > 1 and n not in stats and all(n != x.first + x.left for x in level)]:
            leaves[n] = 1                          # a node without rows has no leaf to fill
    return levels


def leaf_column(levels: Sequence[Sequence[Node]], at: Sequence[Column]) -> Column:
    """The leaf of a row as an expression of its positions: one nested condition per node of the tree."""
    children = {(depth, n.first): n for depth, level in enumerate(levels) for n in level}

    def descend(depth: int, first: int) -> Column:
        while depth < len(levels) and (depth, first) not in children:
            depth += 1
        if depth == len(levels):
            return F.lit(first)
        n = children[(depth, first)]
        return F.when(at[n.dimension] <= F.lit(n.cut), descend(depth + 1, first)).otherwise(descend(depth + 1, first + n.left))

    return descend(0, 0)


def metadata(docs: DataFrame) -> tuple[list[Column], Column]:
    """The dimensions of the tree: length of the text, source, language; and the order of equal rows."""
    whole = F.lit(SPAN - 1)
    return ([F.least(byte_size(F.col("text")), whole), hash31(F.col("source")), hash31(F.col("lang"))],
            hash31(F.lit("shard"), F.col("doc_id"), text_crc(F.col("text"))))


def shard_documents(docs: DataFrame, shards: int = 40, target_bytes: int | None = None,
                    slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Shard and slot of each document, with shards of nearly equal bytes.

    ``docs`` has doc_id, text, source and lang. With ``target_bytes`` the number
    of shards follows from the size of the corpus. Returns doc_id, size,
    text_crc32, law (``bytes``), shard, slot (gapless from 0 in each shard) and
    grown_shard (null under this law).

    Copies of one text differ in their ids and are cut apart where balance asks
    for it. Rows equal in all values stay together. Null texts are empty; null
    ids, sources and languages are values of their own. Texts of any length
    count whole. An empty table gives no rows.
    """
    dims, tie = metadata(docs)
    rows = stored(docs.select(F.col("doc_id"), byte_size(F.col("text")).alias("_size"),
                              text_crc(F.col("text")).alias("text_crc32"), tie.alias("_tie"), *positions(dims, tie)))
    if target_bytes:
        total = rows.agg(F.sum("_size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    levels = grow_tree(rows, len(dims), shards)
    placed = rows.select("doc_id", F.col("_size").alias("size"), "text_crc32", "_tie",
                         leaf_column(levels, [F.col(f"_d{i}") for i in range(len(dims))]).cast("int").alias("shard"))
    numbered = _slots(placed, slot_rows)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame, slot_rows: int) -> DataFrame:
    """Number the rows of each shard from 0 in ranges of the tie order, so that no shard is sorted by one task."""
    per_shard = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows"))
    counts = {r["shard"]: r["_rows"] for r in per_shard.collect()}          # one number per shard
    if not counts:
        return placed.withColumn("slot", F.lit(0))
    ranges = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, -(-n // slot_rows))]), F.col("shard"))
    ranged = placed.withColumn("_range", F.floor(F.col("_tie") * ranges / SPAN))
    inside = Window.partitionBy("shard", "_range").orderBy("_tie", "doc_id", "text_crc32", "size")
    local = stored(ranged.withColumn("_at", F.row_number().over(inside) - 1))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (local.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
            .select(F.col("shard").alias("_shard"), F.col("_range").alias("_r"),
                    F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")))
    return (local.join(sums, (local["shard"] == sums["_shard"]) & (local["_range"] == sums["_r"]))
            .withColumn("slot", F.col("_at") + F.col("_off")))
