"""Benchmark decontamination by a positional inverted index.

Every window of the benchmark asks for its rarest terms first: the postings of
these terms are stored with their positions, moved by the term's place in the
window, and intersected; what is left is compared word by word. The text of the
corpus is read where it lies and never shuffled; common words have no postings
at all unless a window holds nothing rarer. Words are told apart by a 64-bit
hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import stored
from traceaudit.llm.shingles import PLAIN, word_hashes

WINDOW = 13
# Benchmark windows that one pass over the corpus looks for; their terms are broadcast.
BLOCK_WINDOWS = 200_000
# Documents that are looked up by a broadcast list of their keys; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def item_words(benchmark: DataFrame) -> DataFrame:
    """item (id as string) and words (hashes) of each benchmark text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, _, cut in word_hashes(batch.column("text"), PLAIN):
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(words.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(at, len(lists)), lists], names=["item", "words"])
                at += len(lists)

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(run, "item string, words array<bigint>").filter(F.size("words") > 0)


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: words, items, wid.

    An item of fewer than ``width`` words is one window; without words it has none.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    cut = item_words(benchmark).select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, width))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("wid", F.xxhash64("words"))


def term_counts(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """term, n: occurrences of each of ``terms`` (sorted, bounded, broadcast) in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for words, _, _ in word_hashes(batch.column("text"), PLAIN):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                total += np.bincount(at[known[at] == words], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(total)], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).filter("n > 0")


def _anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows whose terms all occur, with the places of their rarest and second rarest word."""
    ranked = (windows.select("wid", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
              .groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.col("n"), F.col("term"), F.col("at")))).alias("_by"),
                                  F.min(F.coalesce(F.col("n"), F.lit(0))).alias("_least")))
    one, two = F.col("_by")[0], F.get(F.col("_by"), F.lit(1))
    chosen = ranked.filter("_least > 0").select(
        F.col("wid").alias("_wid"), one["term"].alias("term1"), one["at"].alias("at1"),
        F.coalesce(two["term"], one["term"]).alias("term2"), F.coalesce(two["at"], one["at"]).alias("at2"))
    return windows.join(chosen, F.col("wid") == F.col("_wid")).drop("_wid")


def build_index(docs: DataFrame, terms: np.ndarray, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """Stored positional index, a row for each document: doc_id, _h, n_words, postings.

    ``postings`` lists each occurrence of ``terms`` (sorted, bounded, broadcast):
    term, pos, and ``around``, the words from ``left`` before it to ``right``
    after it (null where ``left`` is -1; words beyond the text are 0).
    """
    shared = docs.sparkSession.sparkContext.broadcast((terms, left, right))
    kind = docs.schema["doc_id"].dataType.simpleString()
    posting = pa.struct([("term", pa.int64()), ("pos", pa.int32()), ("around", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, before, after = shared.value
        for batch in batches:
            first = 0
            for words, _, cut in word_hashes(batch.column("text"), PLAIN):
                n = len(cut) - 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    hit = np.flatnonzero(known[at] == words)
                else:
                    at, hit = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                owner = np.searchsorted(cut, hit, side="right") - 1
                lists: list[list] = [[] for _ in range(n)]
                signed = words.astype(np.int64)
                for h, o, a in zip(hit.tolist(), owner.tolist(), at[hit].tolist(), strict=True):
                    around = None
                    if before[a] >= 0:
                        lo, hi = h - before[a], h + after[a] + 1
                        a0, a1 = max(lo, cut[o]), min(hi, cut[o + 1])
                        around = [0] * int(a0 - lo) + signed[a0:a1].tolist() + [0] * int(hi - a1)
                    lists[o].append({"term": int(signed[h]), "pos": h - int(cut[o]), "around": around})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("_h").slice(first, n), pa.array(np.diff(cut).astype(np.int64)),
                     pa.array(lists, pa.list_(posting))], names=["doc_id", "_h", "n_words", "postings"])
                first += n

    schema = f"doc_id {kind}, _h bigint, n_words bigint, postings array<struct<term: bigint, pos: int, around: array<bigint>>>"
    return stored(docs.select("doc_id", F.xxhash64("text").alias("_h"), "text").mapInArrow(run, schema))


def _lists(index: DataFrame, windows: DataFrame, which: str) -> DataFrame:
    """Postings of each window's rarest (``1``) or second (``2``) term, moved to the start of the window."""
    asked = windows.select("wid", F.col(f"term{which}").alias("_term"), F.col(f"at{which}").alias("_at"),
                           *([F.col("words"), F.col("items")] if which == "1" else []))
    each = index.filter(F.size("postings") > 0).select(F.col("doc_id").alias("_id"), "_h", F.inline("postings"))
    if which == "1":
        each = each.filter("around is not null")
    moved = each.join(F.broadcast(asked), F.col("term") == F.col("_term")).withColumn("start", F.col("pos") - F.col("_at"))
    return moved if which == "1" else moved.select("_id", "_h", "wid", "start")


def _met(first: DataFrame, second: DataFrame, how: str) -> DataFrame:
    """Rows of the rarest terms that have a row of the second term at the same document, window and start."""
    other = second.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.col("wid").alias("_wid2"), F.col("start").alias("_start2"),
                          *[c for c in second.columns if c not in ("_id", "_h", "wid", "start")])
    return first.join(other, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))
                      & (F.col("wid") == F.col("_wid2")) & (F.col("start") == F.col("_start2")), how)


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact occurrences: _id, _h, start, width, items. ``windows`` is bounded and broadcast."""
    met = _met(_lists(index, windows, "1"), _lists(index, windows, "2"), "left_semi")
    reach = windows.groupBy(F.col("term1").alias("_t")).agg(F.max("at1").alias("_left"))
    met = met.join(F.broadcast(reach), F.col("term") == F.col("_t"))
    text = F.slice("around", F.col("_left") - F.col("_at") + 1, F.size("words"))
    return met.filter((F.col("start") >= 0) & (text == F.col("words"))).select("_id", "_h", "start", F.size("words").alias("width"), "items")


def proximity_matches(index: DataFrame, windows: DataFrame, slop: int = 3) -> DataFrame:
    """Places where a window's two rarest terms stand up to ``slop`` words nearer or farther than in it: _id, _h, wid, start, off."""
    first = _lists(index, windows, "1").select("_id", "_h", "wid", "start")
    second = _lists(index, windows, "2").withColumnRenamed("start", "_s")
    spread = second.select("_id", "_h", "wid", "_s", F.explode(F.sequence(F.col("_s") - slop, F.col("_s") + slop)).alias("start"))
    return _met(first, spread, "inner").select("_id", "_h", "wid", "start", (F.col("_s") - F.col("start")).alias("off")).distinct()


def indexed(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW,
            block_windows: int = BLOCK_WINDOWS) -> list[tuple[DataFrame, DataFrame]]:
    """(index, windows) for each block of the benchmark; a benchmark of any size is taken in blocks of bounded size."""
    whole = stored(windows_of(benchmark, width))
    blocks = max(1, -(-whole.count() // block_windows))
    column = lambda d, c: np.array(d.select(c).toArrow().column(0).to_pylist(), dtype=np.int64)
    out = []
    for b in range(blocks):
        ours = whole.filter(F.pmod(F.col("wid"), F.lit(blocks)) == b)
        terms = np.sort(column(ours.select(F.explode("words").alias("t")).distinct(), "t").astype(np.uint64))
        if len(terms):
            windows = stored(_anchors(ours, stored(term_counts(docs, terms))))
        else:
            windows = stored(ours.withColumns({c: F.lit(0).cast(t) for c, t in (("term1", "long"), ("at1", "int"), ("term2", "long"), ("at2", "int"))}))
        reach = windows.select(F.col("term1").alias("t"), F.col("at1").alias("l"), (F.size("words") - 1 - F.col("at1")).alias("r"))
        wanted = (reach.unionByName(windows.select(F.col("term2").alias("t"), F.lit(-1).alias("l"), F.lit(-1).alias("r")))
                  .groupBy("t").agg(F.max("l").alias("l"), F.max("r").alias("r")).toArrow())
        order = np.argsort(np.array(wanted.column("t").to_pylist(), dtype=np.int64).astype(np.uint64))
        t, left, right = (np.array(wanted.column(c).to_pylist(), dtype=np.int64)[order] for c in "tlr")
        out.append((build_index(docs, t.astype(np.uint64), left, right), windows))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, _h, n_words, n_hit, items for every row of ``docs``.

    Hits of all blocks are merged: a word inside several windows counts once.
    """
    parts = indexed(docs, benchmark, width, block_windows)
    found = None
    for index, windows in parts:
        part = phrase_matches(index, windows)
        found = part if found is None else found.unionByName(part)
    found = stored(found)
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("hit"))

    def cover(acc: Column, m: Column) -> Column:
        stop = m["start"] + m["width"]
        fresh = F.greatest(F.lit(0), stop - F.greatest(acc["upto"], m["start"]))
        return F.struct(F.greatest(acc["upto"], stop).alias("upto"), (acc["hit"] + fresh).cast("long").alias("hit"))

    # A document has at most as many matches as places and widths, so its list is bounded by its own length.
    hits = found.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct("start", "width"))).alias("_m"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("_id").alias("_id2"), F.col("_h").alias("_h2"), F.aggregate("_m", start, cover)["hit"].alias("n_hit"), "items")
    rows = parts[0][0].select("doc_id", "_h", "n_words")
    return (rows.join(hits, F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
            .select("doc_id", "_h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    A document is contaminated if it has a hit and at least one word in
    ``share`` is hit. Null and empty texts have no words and no hits; a null
    item id is not counted among the items; null document ids and repeated rows
    keep their own rows. Texts and items of any length are read whole. An empty
    benchmark leaves all documents clean.
    """
    out = contamination(docs, benchmark, width)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), _contaminated(share).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = stored(contamination(docs, benchmark, width).filter(_contaminated(share)).select(F.col("doc_id").alias("_id2"), F.col("_h").alias("_h2")).distinct())
    small = bad.count() <= BROADCAST_KEYS                       # 16 bytes a row
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    return keyed.join(F.broadcast(bad) if small else bad, F.col("doc_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")),
                      "left_anti").select(*docs.columns)
