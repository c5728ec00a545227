"""Traces as graphs: nodes and edges, quality counts, pooling and neighbour aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.operators.lanes import lane_aggregate, scaled, unit_length
from traceaudit.operators.ranking import ranked, same_keys
from traceaudit.session import cut_lineage

SPAN_BUCKET = 65_536


def parse_time(text: Column) -> Column:
    """Timestamp of an ISO text (a trailing Z is UTC); null when it cannot be read."""
    return F.try_to_timestamp(text)


def build_trace_graph(spans: DataFrame, min_nodes: int = 2, where: Column | None = None) -> DataFrame:
    """Nodes of every trace with their type, index, parent index, times and duration.

    ``spans`` holds ``trace_id, span_idx, task_id, parent_id, tags, start_time,
    end_time``; other columns are kept. ``where`` filters spans first. Traces
    with fewer than ``min_nodes`` nodes are dropped. An unknown parent gives a
    null ``parent_idx``. A trace is cut into buckets of spans, so a huge trace
    is numbered by many tasks.
    """
    rows = spans.filter(where) if where is not None else spans
    bucket = F.floor(F.col("span_idx") / SPAN_BUCKET)
    placed = ranked(rows, ["trace_id"], ["span_idx"], bucket, "__pos", "__nodes")
    placed = placed.filter(F.col("__nodes") >= min_nodes).withColumn("node_idx", F.col("__pos") - 1)
    placed = cut_lineage(placed)                      # numbering reads the spans once; the parent lookup reads the result
    # Tasks are known by their id: of repeated ids the last one counts.
    parents = placed.filter(F.col("task_id").isNotNull()).groupBy("trace_id", F.col("task_id").alias("parent_id")).agg(
        F.max("node_idx").alias("parent_idx"))
    start, end = parse_time(F.col("start_time")), parse_time(F.col("end_time"))
    kept = [c for c in spans.columns if c not in ("start_time", "end_time")]
    linked = placed.join(parents, ["trace_id", "parent_id"], "left")
    return linked.select(
        *kept, "node_idx", "parent_idx",
        F.when(F.array_contains("tags", "llm_call"), "llm_call").otherwise("non_llm").alias("node_type"),
        start.alias("start_time"), end.alias("end_time"),
        (end.cast("double") - start.cast("double")).alias("duration"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """Parent-to-child edges."""
    return nodes.filter(F.col("parent_idx").isNotNull()).select(
        "trace_id", F.col("parent_idx").alias("src_idx"), F.col("node_idx").alias("dst_idx"))


def graph_quality(nodes: DataFrame) -> DataFrame:
    """Per trace: nodes by type, edges, roots and a warning when there is not exactly one root."""
    rootless = F.col("parent_idx").isNull()
    out = nodes.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("node_type") == "llm_call").alias("llm_nodes"),
        F.count_if(F.col("node_type") == "non_llm").alias("other_nodes"),
        F.count_if(~rootless).alias("edges"), F.count_if(rootless).alias("roots"))
    return out.withColumn("warning", F.when(F.col("roots") == 0, "no_root").when(F.col("roots") > 1, "multiple_roots"))


def pool_graph(nodes: DataFrame, width: int, how: str = "mean", features: str = "features",
               score: str | None = None) -> DataFrame:
    """One vector per trace: mean, max or sum of its node vectors, or attention-weighted sum.

    With ``score`` the weights are ``exp(score)`` over their sum in the trace
    plus 1e-8. Everything is one combinable aggregate per trace.
    """
    if score is not None:
        weight = F.exp(F.col(score))
        weighted = nodes.withColumn("__w", weight).withColumn("__x", scaled(features, F.col("__w")))
        summed = lane_aggregate(weighted, ["trace_id"], "__x", width, F.sum, [F.sum("__w").alias("total")])
        return summed.select("trace_id", F.transform(
            "features", lambda x: x / (F.col("total") + F.lit(1e-8))).alias("features"))
    number = {"mean": F.avg, "max": F.max, "add": F.sum}[how]
    return lane_aggregate(nodes, ["trace_id"], features, width, number)


def propagate(nodes: DataFrame, edges: DataFrame, width: int, kind: str = "gcn",
              features: str = "features") -> DataFrame:
    """Parameter-free neighbour aggregation along the edges.

    ``gcn``: every node gets a self loop; a message from j to i is weighted by
    1/sqrt(deg j * deg i) with in-degrees that count the self loop. ``sage``:
    mean of the incoming neighbours (zeros without any) scaled to unit length.
    The edge list is joined with the sending nodes; vectors are summed per
    receiver with map-side combination, so hubs on either end stay cheap.
    """
    vectors = nodes.select("trace_id", "node_idx", F.col(features).alias("__x"))
    if kind == "gcn":
        proper = edges.filter(F.col("src_idx") != F.col("dst_idx"))
        degree = proper.groupBy("trace_id", F.col("dst_idx").alias("node_idx")).agg(
            F.count(F.lit(1)).alias("__in"))
        known = cut_lineage(vectors.join(degree, ["trace_id", "node_idx"], "left").withColumn(
            "__deg", F.coalesce("__in", F.lit(0)) + F.lit(1.0)))
        sent = proper.join(known.select("trace_id", F.col("node_idx").alias("src_idx"),
                                        scaled("__x", 1 / F.sqrt("__deg")).alias("__x")),
                           ["trace_id", "src_idx"]).select("trace_id", F.col("dst_idx").alias("node_idx"), "__x")
        own = known.select("trace_id", "node_idx", scaled("__x", 1 / F.sqrt("__deg")).alias("__x"))
        total = lane_aggregate(sent.unionByName(own), ["trace_id", "node_idx"], "__x", width, F.sum, name="__sum")
        back = known.select("trace_id", "node_idx", "__deg").join(total, ["trace_id", "node_idx"])
        return back.select("trace_id", "node_idx", scaled("__sum", 1 / F.sqrt("__deg")).alias("features"))
    if kind != "sage":
        raise ValueError(f"unknown kind {kind!r}")
    sent = edges.join(vectors.withColumnRenamed("node_idx", "src_idx"), ["trace_id", "src_idx"]).select(
        "trace_id", F.col("dst_idx").alias("node_idx"), "__x")
    mean = lane_aggregate(sent, ["trace_id", "node_idx"], "__x", width, F.avg, name="__mean")
    zeros = F.array_repeat(F.lit(0.0), width)
    out = nodes.select("trace_id", "node_idx").join(mean, ["trace_id", "node_idx"], "left")
    return out.select("trace_id", "node_idx", unit_length(F.coalesce("__mean", zeros)).alias("features"))


def propagate_layers(nodes: DataFrame, edges: DataFrame, width: int, kind: str = "gcn", layers: int = 2,
                     features: str = "features") -> DataFrame:
    """Several layers of :func:`propagate`, each on the vectors of the one before.

    The edges are weighted once and stored by their sending node, with the self
    loops of ``gcn``; from then on a layer shuffles vectors to where their edges
    are and the messages, summed before the shuffle, to their receivers.
    """
    if kind not in ("gcn", "sage"):
        raise ValueError(f"unknown kind {kind!r}")
    places = nodes.select("trace_id", "node_idx")
    if kind == "gcn":
        proper = edges.filter(F.col("src_idx") != F.col("dst_idx")).select("trace_id", "src_idx", "dst_idx")
        inward = proper.groupBy("trace_id", F.col("dst_idx").alias("node_idx")).agg(F.count(F.lit(1)).alias("__in"))
        degree = cut_lineage(places.join(inward, ["trace_id", "node_idx"], "left").select(
            "trace_id", "node_idx", (F.coalesce("__in", F.lit(0)) + F.lit(1.0)).alias("__deg")))
        ends = [degree.select("trace_id", F.col("node_idx").alias(f"{end}_idx"), F.col("__deg").alias(f"__{end}")) for end in ("src", "dst")]
        weighted = proper.join(ends[0], ["trace_id", "src_idx"]).join(ends[1], ["trace_id", "dst_idx"]).select(
            "trace_id", "src_idx", "dst_idx", (1 / F.sqrt(F.col("__src") * F.col("__dst"))).alias("__w"))
        loops = degree.select("trace_id", F.col("node_idx").alias("src_idx"), F.col("node_idx").alias("dst_idx"), (1 / F.col("__deg")).alias("__w"))
        links, number = weighted.unionByName(loops), F.sum
    else:
        links, number = edges.select("trace_id", "src_idx", "dst_idx", F.lit(1.0).alias("__w")), F.avg
    links = cut_lineage(links.repartition("trace_id", "src_idx"))
    now = nodes.select("trace_id", F.col("node_idx").alias("src_idx"), F.col(features).alias("__x"))
    for _ in range(layers):
        sent = links.join(now, ["trace_id", "src_idx"]).select("trace_id", F.col("dst_idx").alias("node_idx"), scaled("__x", F.col("__w")).alias("__m"))
        summed = lane_aggregate(sent, ["trace_id", "node_idx"], "__m", width, number, name="__sum")
        if kind == "sage":
            zeros = F.array_repeat(F.lit(0.0), width)
            summed = places.join(summed, ["trace_id", "node_idx"], "left").withColumn("__sum", unit_length(F.coalesce("__sum", zeros)))
        now = cut_lineage(summed.select("trace_id", F.col("node_idx").alias("src_idx"), F.col("__sum").alias("__x")))
    return now.select("trace_id", F.col("src_idx").alias("node_idx"), F.col("__x").alias("features"))


def batch_ids(traces: DataFrame, size: int = 100) -> DataFrame:
    """Number the traces in name order and group them in batches of ``size``."""
    from traceaudit.operators.ranking import globally_ranked
    placed = globally_ranked(traces.select("trace_id").distinct(), ["trace_id"], "__pos")
    return placed.select("trace_id", F.floor((F.col("__pos") - 1) / size).cast("bigint").alias("batch_id"))


def feature_summary(nodes: DataFrame, by: Sequence[str] = ("trace_id",), features: str = "features") -> DataFrame:
    """Node counts by type and min, max, mean and sample deviation over all feature numbers.

    Each row is reduced to count, mean and squared distance from its own mean;
    these are merged by the distances of the row means from the mean of all,
    relative to one value of the group, so large numbers with a small spread
    keep it.
    """
    x = F.col(features)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = nodes.select(*by, "node_type", x.alias("__x"), F.size(x).alias("__n"), (total / F.size(x)).alias("__m"),
                        F.array_min(x).alias("__lo"), F.array_max(x).alias("__hi"))
    rows = rows.withColumn("__q", F.aggregate("__x", F.lit(0.0), lambda a, v: a + (v - F.col("__m")) * (v - F.col("__m")))).drop("__x")
    at = rows.groupBy(*by).agg(F.min("__m").alias("__at"))
    named = at.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], "__at")
    rows = rows.join(named, same_keys(rows, named, [(c, f"__k{i}") for i, c in enumerate(by)]), "inner")
    shift = F.col("__m") - F.col("__at")
    rows = rows.withColumns({"__s": F.col("__n") * shift, "__q": F.col("__q") + F.col("__n") * shift * shift})
    out = rows.groupBy(*by).agg(F.first("__at").alias("__at"),
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "llm_call").alias("llm_nodes"),
        F.count_if(F.col("node_type") == "non_llm").alias("other_nodes"),
        F.sum("__n").alias("__n"), F.sum("__s").alias("__s"), F.sum("__q").alias("__q"),
        F.min("__lo").cast("double").alias("feature_min"), F.max("__hi").cast("double").alias("feature_max"))
    mean = F.col("__s") / F.col("__n")
    spread = F.try_divide(F.col("__q") - F.col("__n") * mean * mean, (F.col("__n") - 1).cast("double"))
    mean_of_all = F.col("__at") + mean
    return out.select(*by, "nodes", "llm_nodes", "other_nodes", "feature_min", "feature_max",
                      mean_of_all.alias("feature_mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("feature_std"))
