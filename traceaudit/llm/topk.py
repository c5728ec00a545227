"""Exact top-k search by inner product over norm-sorted vectors.

Candidates are laid out in blocks of descending length. Vectors are rotated to
the principal axes of the candidates, so that a few leading coordinates carry
most of a product; the rest is bounded by the Cauchy-Schwarz inequality. Queries
meet the blocks in rounds of descending length, twice as many blocks each time, with
thresholds renewed in between. A pair of blocks is made only if the longest
candidate can reach the threshold of a query, and the search ends with the first
round that has none; inside a pair a row is left out if its partial sum plus the
bound cannot. What is left is scored in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import stored, tidied
from traceaudit.operators.ranking import globally_ranked

SCALE = 64
# Rows of a candidate block and of a query block.
BLOCK = 4_096
QUERY_BLOCK = 2_048
LEADING = 16
MOST_PARTS = 2_000
# Share and amount by which bounds are widened against rounding.
SLACK = 1e-6
# Sums of products below this are exact in floating point.
EXACT = float(2 ** 53)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor of the scaled components) and norm of the vectors that take part.

    Null vectors, and vectors with null or non-finite components, take no part.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = vectors.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


def gram_matrix(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors, added up where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "r"])

    partial = rows.select("v").mapInArrow(run, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "x"))
    out = np.zeros((width, width))
    for r in partial.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():         # width squared numbers
        out[r["i"], r["j"]] = r["x"]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, :len(v)] = v
    return out


def _blocks(rows: DataFrame, size: int, order: list, name: str) -> DataFrame:
    """Rows with the number of their block in ``order``; a range sort over the cluster gives the places."""
    placed = globally_ranked(rows, order, "_place")
    return placed.withColumn(name, F.floor((F.col("_place") - 1) / size).cast("string")).drop("_place")


def _packed(rows: DataFrame, block: str, width: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each block of bounded size: ids, vectors and any extra numbers as bytes, and the largest length."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = {block: table.column(block).slice(0, 1), "ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
               "data": pa.array([_matrix(table.column("v"), width).tobytes()], pa.binary()),
               "top": pa.array([float(table.column("norm").to_numpy().max())], pa.float64())}
        for c in extra:
            out[c] = pa.array([table.column(c).to_numpy().astype(np.float64).tobytes()], pa.binary())
        return pa.table(out)

    schema = f"{block} string, ids binary, data binary, top double" + "".join(f", {c} binary" for c in extra)
    return rows.groupBy(block).applyInArrow(pack, schema)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(x.T)
    return np.vectorize(lambda s: max(-2**63, min(2**63 - 1, int(s))), otypes=[np.int64])(exact)


def best_in_block(qid: np.ndarray, q: np.ndarray, least: np.ndarray, cid: np.ndarray, x: np.ndarray, top: float, basis: np.ndarray,
                  k: int, leading: int = LEADING) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, scores) of up to ``k`` rows of one block for each query; rows that cannot reach ``least`` are passed over."""
    slack = SLACK
    reach = np.sqrt((q * q).sum(axis=1)) * top
    asked = np.flatnonzero(reach * (1 + slack) + slack >= least)
    if not len(asked) or not len(cid):
        return
    qr, xr = q[asked] @ basis, x @ basis
    rest_q = np.sqrt((qr[:, leading:] ** 2).sum(axis=1))
    rest_x = np.sqrt((xr[:, leading:] ** 2).sum(axis=1))
    partial = qr[:, :leading] @ xr[:, :leading].T
    bound = partial + np.outer(rest_q, rest_x)
    bound += slack * (1 + np.abs(partial) + np.outer(np.sqrt((qr ** 2).sum(axis=1)), np.sqrt((xr ** 2).sum(axis=1))))
    for row, i in enumerate(asked):
        live = np.flatnonzero((bound[row] >= least[i]) & (cid != qid[i]))
        if not len(live):
            continue
        s = _scores(q[i:i + 1], x[live])[0]
        good = np.flatnonzero(s >= least[i]) if np.isfinite(least[i]) else np.arange(len(s))
        best = good[np.lexsort((cid[live[good]], -s[good]))[:k]]
        yield int(qid[i]), cid[live[best]], s[best]


def _search(pairs: DataFrame, basis: np.ndarray, width: int, k: int) -> DataFrame:
    """Best rows for each pair of a query block and a candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"]).reshape(-1, width)
                q = np.frombuffer(r["q_data"]).reshape(-1, width)
                out = list(best_in_block(np.frombuffer(r["q_ids"], dtype=np.int64), q, np.frombuffer(r["least"]),
                                         np.frombuffer(r["ids"], dtype=np.int64), x, r["top"], basis, k))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(c), i) for i, c, _ in out])), pa.array(np.concatenate([c for _, c, _ in out])),
                         pa.array(np.concatenate([s for _, _, s in out]))], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@tidied
def top_inner_products(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the ``k`` rows with the largest inner products.

    ``vectors`` has vec_id and embedding. A query's own row is no candidate; ties
    go to the smaller id; a query with fewer other rows gets all of them. Rows
    that repeat an id and a vector count once. Vectors of different length are
    compared as if filled up with zeros. Scores beyond 64 bits become the
    largest or smallest number. Null ids take no part. An empty table gives no
    rows.

    Queries, a fixed share of all rows, meet the candidates block by block; each
    pair of blocks is a task's row of bounded size, and there is no order or list
    of all scores of a query anywhere.
    """
    rows = stored(quantized(vectors).distinct())
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    _, basis = np.linalg.eigh(gram_matrix(rows, width))
    basis = np.ascontiguousarray(basis[:, ::-1])
    placed = stored(_blocks(rows, BLOCK, [F.desc("norm"), F.col("vec_id")], "block"))
    packed = stored(_packed(placed, "block", width))
    asked = stored(_blocks(rows.filter(F.pmod("vec_id", F.lit(every)) == 0), QUERY_BLOCK, [F.col("vec_id")], "q_block"))
    total = packed.count()
    seen, low, span = None, 0, 1
    while low < total:
        found = _round(asked, packed, seen, low, low + span, basis, width, k)
        if found is None:                                 # all later blocks are shorter still
            break
        seen, low, span = found, low + span, 2 * span
    if seen is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(seen, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _round(asked: DataFrame, packed: DataFrame, seen: DataFrame | None, low: int, high: int, basis: np.ndarray, width: int, k: int) -> DataFrame | None:
    """The best rows after some more blocks, stored; None if none of these blocks can hold one."""
    known = asked.withColumn("least", F.lit(float("-inf")))
    if seen is not None:
        # The k-th score so far: nothing below it can be among the best k. Fewer than k: no threshold.
        level = seen.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("_level"))
        known = (asked.join(level, F.col("vec_id") == F.col("query_id"), "left")
                 .withColumn("least", F.coalesce("_level", F.lit(float("-inf")))).drop("_level", "query_id"))
    known = stored(known)
    pairs = stored(block_pairs(known, packed, low, high))
    made = pairs.count()
    if not made:
        return None
    queries = (_packed(known.join(pairs.select(F.col("q_block").alias("_q")).distinct(), F.col("q_block") == F.col("_q"), "left_semi"), "q_block", width, ("least",))
               .withColumnRenamed("ids", "q_ids").withColumnRenamed("data", "q_data").drop("top"))
    # Query blocks travel to the candidate blocks; a fixed number of parts keeps one block to a task where there are few.
    parts = max(1, min(made, MOST_PARTS))
    met = pairs.join(queries.withColumnRenamed("q_block", "_q"), F.col("q_block") == F.col("_q")).drop("_q", "q_block").withColumnRenamed("block", "_b")
    both = met.repartition(parts, "_b").join(packed.repartition(parts, "block"), F.col("_b") == F.col("block")).drop("_b")
    found = _search(both, basis, width, k)
    best = found if seen is None else seen.unionByName(found)
    return stored(_ranked(best, k).select("query_id", "vec_id", "score"))


def block_pairs(known: DataFrame, packed: DataFrame, low: int, high: int) -> DataFrame:
    """(q_block, block) of the candidate blocks number ``low`` to ``high`` - 1 that a query block has to meet: some query's
    threshold is within its own length times that of the longest candidate.

    This is decided on one number per block; vectors travel for these pairs only.
    """
    free = (F.col("least") == float("-inf")) | ((F.col("norm") == 0) & (F.col("least") <= SLACK))
    need = (F.when(free, float("-inf")).when(F.col("norm") == 0, float("inf"))
            .otherwise((F.col("least") - SLACK) / (F.col("norm") * (1 + SLACK)) * (1 - F.signum(F.col("least") - SLACK) * 1e-9)))
    wanted = known.groupBy("q_block").agg(F.min(need).alias("need"))
    number = F.col("block").cast("long")
    some = packed.select("block", "top").filter((number >= low) & (number < high))
    return some.join(wanted, F.col("top") >= F.col("need")).select("q_block", "block")
