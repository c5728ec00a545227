"""Jaccard join of documents on word n-grams by prefix filtering.

The n-grams of a document are put in one order for all documents, rare ones
first; two sets that are similar enough then share a gram among the first few of
each. Documents meet on these prefix grams, pairs pass length, positional and
suffix filters, and what is left is verified once per pair on the whole texts.

Documents with equal sets are one class and are never paired. For components,
groups that share a gram are first paired with two of their members only; further
pairs are made only between members that are not connected yet, so that a group
of thousands of copies costs a multiple of its size, and no link between
components is lost. As every link lies inside a component, links are counted
there: all pairs of a component's classes are compared, block by block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import stored, tidied
from traceaudit.llm.components import components
from traceaudit.llm.shingles import mix, shingle_sets

# Links need 100 * intersection >= 75 * union, that is 175 * intersection >= 75 * (sum of the sizes).
NEED, OF = 75, 175
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
BINS = 256
# Estimated rows of one gram above which its group is dealt to several tasks.
HOT_ROWS = 100_000
# Rows of a gram from which its unconnected members first meet some of its largest component, before they meet each other.
CROWD = 64
PIVOTS = 8
# Earlier grams of its set that a row of a crowded group knows.
EARLIER = 8
# Classes, and grams, of a component that are compared with others at a time when links are counted; grams of a step of it.
BLOCK_CLASSES, BLOCK_GRAMS = 256, 1 << 20
STEP_GRAMS = 1 << 13
# Texts that are looked up by a broadcast list of their hashes; more are joined by shuffle.
BROADCAST_TEXTS = 1_000_000


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _node(grams: np.ndarray) -> int:
    """The class of a set: a 64-bit hash that does not depend on the order of its grams."""
    return int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], dtype=np.uint64)).astype(np.int64)[0])


def _packed(counts: np.ndarray) -> bytes:
    """Counts in two bytes each, or in four where two do not hold them."""
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.int32).tobytes()


def _unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 2 * BINS for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.uint16).reshape(-1, BINS)
    return np.array([np.frombuffer(r, dtype=np.uint16 if len(r) == 2 * BINS else np.int32) for r in rows], dtype=np.int32)


def survey(docs: DataFrame) -> DataFrame:
    """One stored pass over the texts: a row for each document, and partial counts of gram buckets.

    Document rows have doc_id, _h (hash of the text), node (class; null without
    words), n (set size) and bins (the set's counts over 256 ranges of the hash).
    Rows with ``block`` hold counts of a block of the frequency sketch, one set
    for each task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _h bigint, node bigint, n int, bins binary, block int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, ids = np.zeros(1 << SKETCH_BITS, dtype=np.int32), None
        for batch in batches:
            nodes, sizes, bins, ids = [], [], [], batch.column("doc_id")
            for grams in shingle_sets(batch.column("text")):
                sizes.append(len(grams))
                if len(grams):
                    np.add.at(sketch, _bucket(grams), 1)
                    nodes.append(_node(grams))
                    bins.append(_packed(np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=BINS)))
                else:
                    nodes.append(None)
                    bins.append(None)
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("_h"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bins, pa.binary()), none,
                 pa.nulls(len(sizes), pa.binary())], names=["doc_id", "_h", "node", "n", "bins", "block", "counts"])
        if ids is not None:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_BLOCKS, ids.type), pa.nulls(SKETCH_BLOCKS, pa.int64()), pa.nulls(SKETCH_BLOCKS, pa.int64()),
                 pa.nulls(SKETCH_BLOCKS, pa.int32()), pa.nulls(SKETCH_BLOCKS, pa.binary()),
                 pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())],
                names=["doc_id", "_h", "node", "n", "bins", "block", "counts"])

    return stored(docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").mapInArrow(run, schema))


def frequency_sketch(surveyed: DataFrame) -> np.ndarray:
    """How many documents hold a gram of each bucket: a table of fixed size over the whole corpus."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, dtype=np.int32)
        for part in table.column("counts"):
            total = np.maximum(total, total + np.frombuffer(zlib.decompress(part.as_py()), dtype=np.int32))     # a full counter stays full
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    partial = surveyed.filter("block is not null").select("block", "counts")
    rows = partial.groupBy("block").applyInArrow(add, "block int, counts binary").collect()    # 16 MB in all
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    width = len(out) // SKETCH_BLOCKS
    for r in rows:
        out[r["block"] * width:(r["block"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int32)
    return out


def prefix_grams(docs: DataFrame, sketch: Broadcast, hot_rows: int = HOT_ROWS) -> DataFrame:
    """gram, salt, node, n, pos: the first grams of each set in the order (bucket frequency, hash), one row each.

    A set of n grams needs the first n // 4 + 1 of them. ``salt`` deals the rows of a hot gram to several groups; it is -1 for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            nodes, sizes, lists, salts = [], [], [], []
            for grams in shingle_sets(batch.column("text")):
                if len(grams):
                    often = counts[_bucket(grams)]
                    first = np.lexsort((grams, often))[:len(grams) // 4 + 1]
                    node = _node(grams)
                    nodes.append(node)
                    sizes.append(len(grams))
                    lists.append(grams[first].astype(np.int64))
                    often = often[first].astype(np.int64)
                    salts.append(np.where(often > hot_rows, node % (1 + often // hot_rows), -1).astype(np.int32))
            if nodes:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(salts)))], names=["node", "n", "grams", "salts"])

    listed = docs.select("text").mapInArrow(run, "node bigint, n int, grams array<bigint>, salts array<int>")
    return (listed.select("node", "n", F.posexplode(F.arrays_zip("grams", "salts")).alias("pos", "g"))
            .select(F.col("g.grams").alias("gram"), F.col("g.salts").alias("salt"), "node", "n", "pos"))


def shared_grams(prefixes: DataFrame) -> DataFrame:
    """Prefix grams that at least two classes have, each class once: gram, node, n, pos. Hot grams are kept as they are."""
    group = Window.partitionBy("gram", "salt")
    marked = (prefixes.withColumn("_before", F.lag("node").over(group.orderBy("node")))
              .withColumn("_low", F.min("node").over(group)).withColumn("_high", F.max("node").over(group)))
    fresh = F.col("_before").isNull() | (F.col("_before") != F.col("node"))
    return stored(marked.filter(fresh & ((F.col("_low") != F.col("_high")) | (F.col("salt") >= 0))).select("gram", "node", "n", "pos"))


def _may_link(n1: Column, pos1: Column, n2: Column, pos2: Column) -> Column:
    """Length filter, and positional filter: from their first common gram on, both sets hold enough grams for a link.

    Later common grams of a pair may fail the test; the first one never does.
    """
    length = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * NEED
    return length & (F.least(n1 - pos1, n2 - pos2) * OF >= (n1 + n2) * NEED)


@tidied
def star_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs of each group's first and last class with its other classes."""
    me = F.struct("node", "n", "pos")
    ends = shared.groupBy("gram").agg(F.min(me).alias("_lo"), F.max(me).alias("_hi")).filter(F.col("_lo.node") != F.col("_hi.node"))
    ends = stored(ends)
    met = shared.join(ends.withColumnRenamed("gram", "_gram"), F.col("gram") == F.col("_gram"))
    each = met.select("node", "n", "pos", F.explode(F.array("_lo", "_hi")).alias("_p")).filter(F.col("_p.node") != F.col("node"))
    return stored(_ordered(each.filter(_may_link(F.col("n"), F.col("pos"), F.col("_p.n"), F.col("_p.pos"))), F.col("node"), F.col("_p.node")))


def _ordered(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


@tidied
def mixed_groups(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the grams whose classes are not all connected, stored: gram, node, n, pos, comp, main (the largest component), rows."""
    comp = roots.withColumnRenamed("node", "_node")
    named = stored(shared.select("gram", "node", "n", "pos").join(comp, F.col("node") == F.col("_node"), "left")
                   .select("gram", "node", "n", "pos", F.coalesce("root", "node").alias("comp")))
    # Counts per gram and component are combinable.
    per = named.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("_c"))
    top = per.groupBy("gram").agg(F.max(F.struct("_c", "comp")).alias("_top"), F.count(F.lit(1)).alias("_k"), F.sum("_c").alias("rows")).filter("_k > 1")
    top = stored(top.select(F.col("gram").alias("_gram"), F.col("_top.comp").alias("main"), "rows"))
    return stored(named.join(top, F.col("gram") == F.col("_gram")).drop("_gram"))


@tidied
def pivot_pairs(mixed: DataFrame) -> DataFrame:
    """In crowded groups, distinct pairs of each member outside the largest component with some of that component, drawn by hash."""
    crowd = mixed.filter(F.col("rows") >= CROWD)
    draw = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "pos")).alias(f"_p{k}") for k in range(PIVOTS)]
    pivots = stored(crowd.filter("comp = main").groupBy("gram").agg(*draw).select(F.col("gram").alias("_gram"), *[f"_p{k}" for k in range(PIVOTS)]))
    met = crowd.filter("comp <> main").join(pivots, F.col("gram") == F.col("_gram"))
    each = met.select("node", "n", "pos", F.explode(F.array(*[f"_p{k}" for k in range(PIVOTS)])).alias("_p"))
    return stored(_ordered(each.filter(_may_link(F.col("n"), F.col("pos"), F.col("_p.n"), F.col("_p.pos"))), F.col("node"), F.col("_p.node")))


@tidied
def open_pairs(mixed: DataFrame) -> DataFrame:
    """Distinct pairs of classes that share a prefix gram, may link, and are not connected yet.

    In each group the members outside its largest component meet all others. A
    pair mostly comes out at its first common gram only: each row knows the first
    few grams of its own set in such groups, and two rows that share an earlier
    one of these leave the pair to it. Pairs that come out again are merged.
    """
    spot = F.struct("pos", "gram")
    lists = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(spot)), 1, EARLIER).alias("_first")).withColumnRenamed("node", "_node")
    earlier = F.transform(F.filter("_first", lambda g: g["pos"] < F.col("pos")), lambda g: g["gram"])
    rows = stored(mixed.join(lists, F.col("node") == F.col("_node")).withColumn("before", earlier).drop("_node", "_first"))
    left = rows.filter("comp <> main").select(*[F.col(c).alias(f"l_{c}") for c in ("gram", "node", "n", "pos", "comp", "before")])
    met = left.join(rows, (F.col("l_gram") == F.col("gram")) & (F.col("l_comp") != F.col("comp"))
                    & ((F.col("comp") == F.col("main")) | (F.col("l_node") < F.col("node")))
                    & _may_link(F.col("l_n"), F.col("l_pos"), F.col("n"), F.col("pos"))
                    & ~F.arrays_overlap("l_before", "before"))
    return stored(_ordered(met, F.col("l_node"), F.col("node")))


def suffix_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sets can still overlap enough: in each of 256 ranges of the hash they share at most the smaller count."""
    side = lambda x: classes.select(F.col("node").alias(f"_{x}"), F.col("n").alias(f"n_{x}"), F.col("bins").alias(f"bins_{x}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_unpacked(batch.column(f"bins_{s}")) for s in "ab")
                sizes = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
                good = pa.array(np.minimum(x, y).sum(axis=1, dtype=np.int64) * OF >= sizes * NEED)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """Links among ``pairs`` (a, b), stored: those whose sets of grams are similar enough, counted on the whole texts."""
    return _verified(pairs, classes, docs, broadcast_texts)


@tidied
def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, broadcast_texts: int) -> DataFrame:
    pairs = stored(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("_x")).distinct()
    wanted = stored(classes.join(nodes, F.col("node") == F.col("_x"), "left_semi").select("node", "_h"))
    keys = wanted.withColumnRenamed("_h", "_key")
    small = keys.count() <= broadcast_texts                       # 16 bytes a row
    found = docs.select("text").withColumn("_h", F.xxhash64("text")).join(F.broadcast(keys) if small else keys, F.col("_h") == F.col("_key"))
    # Copies of one text are equal, so any of them serves.
    texts = stored(found.groupBy("node").agg(F.first("text").alias("text")))
    left = pairs.join(texts.withColumnRenamed("text", "text_a"), F.col("a") == F.col("node")).select("a", "b", "text_a")
    both = left.join(texts.withColumnRenamed("text", "text_b"), F.col("b") == F.col("node")).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [OF * len(np.intersect1d(x, y, assume_unique=True)) >= NEED * (len(x) + len(y))
                    for x, y in zip(shingle_sets(batch.column("text_a")), shingle_sets(batch.column("text_b")), strict=True)]
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return stored(both.mapInArrow(run, "a bigint, b bigint"))


def _intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``sets`` with all ``others``."""
    out = np.zeros((len(sets), len(others)), dtype=np.int64)
    grams, place = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    row = np.repeat(np.arange(len(sets) + len(others)), [len(x) for x in [*sets, *others]])
    mine = row < len(sets)
    # Only grams of both sides count; they are numbered anew.
    both = (np.bincount(place[mine], minlength=len(grams)) > 0) & (np.bincount(place[~mine], minlength=len(grams)) > 0)
    use = both[place]
    place, row = (np.cumsum(both) - 1)[place[use]], row[use]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    for at in range(0, int(both.sum()), STEP_GRAMS):
        lo, hi = np.searchsorted(place, [at, at + STEP_GRAMS])
        cells = np.zeros((len(sets) + len(others), STEP_GRAMS), dtype=np.float32)
        cells[row[lo:hi], place[lo:hi] - at] = 1
        out += (cells[:len(sets)] @ cells[len(sets):].T).astype(np.int64)
    return out


def _count_block(table: pa.Table) -> pa.Table:
    """node, links of the classes of two blocks, or of one: rows that the classes of the other block, or the others of the block, stand for and that link."""
    node = table.column("node").to_numpy()
    table = table.take(np.unique(node, return_index=True)[1])
    sets, node = [], table.column("node").to_numpy()
    for chunk in table.column("text").chunks:
        sets.extend(shingle_sets(chunk))
    copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    out = np.zeros(len(node), dtype=np.int64)
    if len(a) and len(b):
        link = _intersections([sets[i] for i in a], [sets[i] for i in b]) * OF >= (sizes[a][:, None] + sizes[b]) * NEED
        if low == high:
            np.fill_diagonal(link, False)
            out[a] = link @ copies[a]
        else:
            out[a], out[b] = link @ copies[b], copies[a] @ link
    return pa.table({"node": pa.array(node), "links": pa.array(out)})


@tidied
def link_counts(roots: DataFrame, classes: DataFrame, docs: DataFrame, broadcast_texts: int = BROADCAST_TEXTS) -> DataFrame:
    """node, links of the classes in ``roots`` (node, root): how many rows of other classes each row of the class links with.

    All pairs of a component are compared. Its classes are dealt into blocks by
    hash, and each two blocks, and each block with itself, are a task of their own.
    """
    members = (roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
               .join(classes.select(F.col("node").alias("_x"), "n", "copies", "_one"), F.col("node") == F.col("_x")).drop("_x"))
    members = stored(members)
    per = members.groupBy("root").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_n")).select(
        F.col("root").alias("_root"), F.greatest(F.ceil(F.col("_c") / BLOCK_CLASSES), F.ceil(F.col("_n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = stored(members.join(per, F.col("root") == F.col("_root")).select(
        "node", "root", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        F.col("_one._h").alias("_key"), F.col("_one.doc_id").alias("_id")))
    small = dealt.count() <= broadcast_texts                      # some 60 bytes a row
    # One row brings the text of its class, or a few that agree in id and text.
    found = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text")).join(
        F.broadcast(dealt) if small else dealt, (F.col("_h") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    each = found.select("root", "node", "copies", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o"))
    each = each.select("root", "node", "copies", "block", "text", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"))
    counted = each.groupBy("root", "low", "high").applyInArrow(_count_block, "node bigint, links bigint")
    return stored(counted.groupBy("node").agg(F.sum("links").alias("links")))


@tidied
def linked_classes(docs: DataFrame, surveyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, roots): node, _h, n, bins, copies (rows) and _one (hash and id of a row) of each class, and node with root of linked classes."""
    rows = surveyed.filter("node is not null")
    classes = stored(rows.groupBy("node").agg(F.min("_h").alias("_h"), F.max("n").alias("n"), F.max("bins").alias("bins"), F.count(F.lit(1)).alias("copies"),
                                                F.min(F.struct("_h", F.col("doc_id").isNull().alias("_none"), "doc_id")).alias("_one")))
    roots, mixed, tried = _connected(docs, surveyed, classes)
    rest = open_pairs(mixed).join(tried, ["a", "b"], "left_anti")
    return classes, _grown(roots, verify(suffix_filter(rest, classes), classes, docs))


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: what was linked before is a star of one edge a node, not all its links."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


@tidied
def _first_meetings(docs: DataFrame, surveyed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, groups that are still mixed, pairs tried) after each group's first and last class have met the others."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(surveyed))
    shared = shared_grams(prefix_grams(docs, sketch))
    sketch.destroy()                                              # 16 MB on the driver and on each executor
    tried = star_pairs(shared)
    roots = components(verify(suffix_filter(tried, classes), classes, docs))
    return roots, mixed_groups(shared, roots), tried


@tidied
def _connected(docs: DataFrame, surveyed: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same after crowded groups have met their pivots as well."""
    roots, mixed, tried = _first_meetings(docs, surveyed, classes)
    pairs = stored(pivot_pairs(mixed).join(tried, ["a", "b"], "left_anti"))
    roots = _grown(roots, verify(suffix_filter(pairs, classes), classes, docs))
    return roots, mixed_groups(mixed, roots), stored(tried.unionByName(pairs))


@tidied
def _assigned(docs: DataFrame, counts: bool = False) -> DataFrame:
    """doc_id, _h, n, node (null without words), group (class that stands for the component), _least and, with ``counts``, n_links of each row."""
    surveyed = survey(docs)
    classes, roots = linked_classes(docs, surveyed)
    rows = surveyed.filter("block is null").select("doc_id", "_h", "node", "n")
    ids = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("_own"))
    roots = stored(roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root")).distinct())
    linked = ids.join(roots, "node").select("node", "root", "_own")
    least = linked.groupBy("root").agg(F.min("_own").alias("_all"))
    named = (ids.join(linked.select("node", "root"), "node", "left").join(least, "root", "left")
             .select(F.col("node").alias("_node"), F.coalesce("root", "node").alias("group"), F.coalesce("_all", "_own").alias("_least")))
    if counts:
        linking = link_counts(roots.select("node", "root"), classes, docs).withColumnRenamed("node", "_x")
        degree = (classes.join(linking, F.col("node") == F.col("_x"), "left")
                  .select(F.col("node").alias("_y"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
        named = named.join(degree, F.col("_node") == F.col("_y")).drop("_y")
    named = stored(named)
    return stored(rows.join(named, F.col("node") == F.col("_node"), "left").drop("_node"))


@tidied
def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text).

    component_id is the smallest id that links reach. Null texts and texts
    without words have no shingles, link with nothing and are their own
    component. A null id never is the smallest, unless a component has no other.
    Repeated rows and equal texts are one class. ``n_links`` counts all other
    rows that the row links with, equal texts included. An empty table gives no
    rows.
    """
    return _assigned(docs.select("doc_id", "text"), counts=True).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@tidied
def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest id, with all columns.

    Rows without words are linked with nothing and stay; those that repeat both
    id and text, null ids included, are merged into one.
    """
    named = _assigned(docs.select("doc_id", "text"))
    first = named.filter("node is not null").groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", "_least").alias("i"), "doc_id", "_h")).alias("_m"))
    plain = named.filter("node is null").select("doc_id", "_h")
    kept = stored(first.select("_m.doc_id", "_m._h").unionByName(plain).distinct().select(F.col("doc_id").alias("_i"), F.col("_h").alias("_k")))
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    met = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_k")), "left_semi")
    return met.dropDuplicates(["doc_id", "_h"]).select(*docs.columns)
