"""Scoring by a hierarchical Pitman-Yor language model.

Words are told apart by a 64-bit hash. Every word of the training texts has a
restaurant of its own for the words that follow it, and every word is a dish of
its own; the parent of these restaurants is the root, the restaurant of all
words, whose base spreads one share over the known words and keeps one for the
unknown. Nothing bounds the number of restaurants or dishes.

Counts of all pairs are made by a shuffle. Pairs that occur once have one table;
the others are seated by Gibbs sweeps in Spark's tasks. The tables of each word
are added up for the root at each exchange: after the burn-in and after the
samples. Between exchanges a restaurant sweeps on with the root's probabilities
of the last one. Probabilities come from tables averaged over the samples, and
those of all words and the unknown add up to 1 in each context.

The most frequent words and pairs are broadcast to spare rows; all others are
counted, seated and looked up by joins.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.llm.common import fold_of, stored, tidied
from traceaudit.llm.shingles import mix, word_hashes

# Words, and dishes of contexts, that are broadcast at most; the rest is joined.
LOOKUP = 1 << 18
DISHES = 1 << 20
# Pairs of one restaurant that are seated together; larger ones are seated in parts.
PART = 1 << 16
# Rows that are worked on at a time.
GATHER = 1 << 20
# Tokens of the texts that are read together: their pairs travel in blocks, one for each bucket.
CHUNK = 1 << 19
# Dishes that are seated one after another, when no more are left.
FEW = 64
# Rounds in which pairs are looked up, each with its share of them on disk.
ROUNDS = 4
BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
END = np.uint64(0x5EED0E4D5EED0E4D)


def _chance(key: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on the key and the turn alone, so that reruns agree."""
    salt = mix(np.atleast_1d(np.asarray(turn, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return ((mix(key ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, key: np.ndarray, turn: int) -> np.ndarray:
    """Number of tables at which the customers of each dish sit.

    They are seated one by one: with i of them at t tables the next opens a table
    with probability a / (a + i - discount * t), where ``opening`` is a. The first
    are drawn one at a time; after that the next opening is drawn at once from
    the ratio of gamma functions, by its standard expansion.
    """
    customers = customers.astype(np.int64)
    tables = (customers > 0).astype(np.int64)
    draw = turn * 100_003
    live = np.flatnonzero(customers > 1)
    c, a, k, t = customers[live], opening[live], key[live], tables[live]
    for seated in range(1, 25):
        if not len(live):
            return tables
        draw += 1
        t += _chance(k, draw) * (a + seated - discount * t) < a
        more = c > seated + 1
        tables[live[~more]] = t[~more]
        live, c, a, k, t = (x[more] for x in (live, c, a, k, t))
    tables[live] = t
    seated = np.minimum(customers, 25)
    while len(live) > FEW:
        a, draw = np.maximum(opening[live], 1e-12), draw + 1
        shift = (a - 1) / 2 - discount * tables[live]
        reach = np.log(seated[live] + shift) - np.log(_chance(key[live], draw)) / a
        upto = np.exp(np.minimum(reach, 60.0)) - shift
        done = upto >= customers[live]
        tables[live] += ~done
        seated[live] = np.where(done, customers[live], np.maximum(np.floor(np.minimum(upto, 2.0 ** 60)).astype(np.int64), seated[live]) + 1)
        live = live[~done & (seated[live] < customers[live])]
    for i in live.tolist():
        tables[i] += _opened(int(customers[i]), int(seated[i]), int(tables[i]), max(float(opening[i]), 1e-12), discount, key[i], draw)
    return tables


def _opened(customers: int, seated: int, tables: int, a: float, discount: float, key: np.uint64, draw: int) -> int:
    """Tables that the rest of one dish's customers open: the last steps of :func:`seat`, which a few dishes have very many of."""
    begin = tables
    while True:
        for step in (np.log(_chance(key, draw + 1 + np.arange(256))) / a).tolist():
            shift = (a - 1) / 2 - discount * tables
            upto = math.exp(min(math.log(seated + shift) - step, 60.0)) - shift
            if upto >= customers:
                return tables - begin
            tables += 1
            seated = max(int(min(upto, 2.0 ** 60)), seated) + 1
            if seated >= customers:
                return tables - begin
        draw += 256


def discount_of(ones: float, twos: float) -> float:
    """Estimate of the discount from the numbers of dishes that occur once and twice."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.9)) if ones else 0.5


@dataclass
class Contexts:
    """Averaged predictive log10 probabilities, (contexts, dishes); words first, then endings, "rare" the last dish."""

    logs: np.ndarray


def sample_contexts(counts: np.ndarray, parents: np.ndarray, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Contexts:
    """Gibbs sweeps over the context restaurants.

    ``counts`` is (words + endings, dishes) customers; ``parents`` the ending of each word context. The size is fixed by parameters.
    """
    n_words, dishes = len(parents), counts.shape[1]
    endings = len(counts) - n_words
    base = np.full(dishes, 1.0 / dishes)
    keys = mix(np.arange(1, (len(counts) + 1) * dishes + 1, dtype=np.uint64))
    key = lambda lo, hi: keys[lo * dishes:hi * dishes]
    d2, d1 = (discount_of((c == 1).sum(), (c == 2).sum()) for c in (counts[:n_words], counts[n_words:]))
    d0 = 0.5
    low, mid, top = (counts[:n_words] > 0).astype(np.int64), (counts[n_words:] > 0).astype(np.int64), np.zeros(dishes, dtype=np.int64)
    total = np.zeros(counts.shape)

    def predict(c: np.ndarray, t: np.ndarray, d: float, above: np.ndarray) -> np.ndarray:
        full = c.sum(axis=-1, keepdims=True) + STRENGTH
        return (np.maximum(c - d * t, 0) + (STRENGTH + d * t.sum(axis=-1, keepdims=True)) * above) / full

    for sweep in range(burn_in + samples):
        at_mid = counts[n_words:].astype(np.int64)
        np.add.at(at_mid, parents, low)
        at_top = mid.sum(axis=0)
        root = predict(at_top, top, d0, base)
        ending = predict(at_mid, mid, d1, root)
        # Each restaurant's customers take their seats anew, given the number of tables of the other dishes.
        low = seat(counts[:n_words].ravel(), ((STRENGTH + d2 * low.sum(axis=1, keepdims=True)) * ending[parents]).ravel(), d2,
                   key(0, n_words), 3 * sweep).reshape(n_words, dishes)
        at_mid = counts[n_words:].astype(np.int64)
        np.add.at(at_mid, parents, low)
        mid = seat(at_mid.ravel(), ((STRENGTH + d1 * mid.sum(axis=1, keepdims=True)) * root).ravel(), d1,
                   key(n_words, n_words + endings), 3 * sweep + 1).reshape(endings, dishes)
        at_top = mid.sum(axis=0)
        top = seat(at_top, (STRENGTH + d0 * top.sum()) * base, d0, key(n_words + endings, n_words + endings + 1), 3 * sweep + 2)
        if sweep >= burn_in:
            root = predict(at_top, top, d0, base)
            ending = predict(at_mid, mid, d1, root)
            total += np.vstack([predict(counts[:n_words], low, d2, ending[parents]), ending])
    return Contexts(np.log10(total / samples))


@dataclass
class Lookup:
    """The broadcast part of the vocabulary, by ascending hash."""

    hashes: np.ndarray
    counts: np.ndarray
    roots: np.ndarray           # probability at the root
    shares: np.ndarray          # strength and discounts of the word's restaurant, which go to the root


class Finder:
    """Places of numbers among ascending ones that are spread evenly, as hashes are: their first bits tell about where."""

    def __init__(self, among: np.ndarray) -> None:
        bits = max(1, len(among).bit_length())
        self.shift, self.n = np.uint64(64 - bits), len(among)
        self.first = np.searchsorted(among, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.among = np.append(among, np.uint64(2**64 - 1))

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """Place of each number, or -1."""
        at = self.first[(numbers >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.among[at] < numbers)
        while len(behind):
            at[behind] += 1
            behind = behind[self.among[at[behind]] < numbers[behind]]
        return np.where((self.among[at] == numbers) & (at < self.n), at, -1)


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit number of a pair; with it the context gives the word back."""
    return ((u << np.uint64(21)) | (u >> np.uint64(43))) ^ w


def _pair_of(u: Column, w: Column) -> Column:
    """The same in Spark; of a context and its pair's number it makes the word."""
    return F.shiftleft(u, 21).bitwiseOR(F.shiftrightunsigned(u, 43)).bitwiseXOR(w)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, tokens of each text, context of each token, token) of some texts at a time.

    An end follows each text; a text starts after an end.
    """
    first = 0
    for words, _, cut in word_hashes(batch.column("text")):
        n = len(cut) - 1
        sizes = np.diff(cut) + 1
        tokens = np.full(len(words) + n, END)
        inner = np.ones(len(tokens), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        tokens[inner] = words
        yield first, sizes, np.concatenate(([END], tokens[:-1])), tokens
        first += n


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, held, tokens of each text, context of each token, token) of about ``size`` tokens at a time."""
    parts, n = [], 0

    def whole() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, *numbers = zip(*parts, strict=True)
        return pa.concat_arrays(ids), *map(np.concatenate, numbers)

    for batch in batches:
        outside = batch.column("held").to_numpy(zero_copy_only=False)
        for first, sizes, context, tokens in _read(batch):
            parts.append((batch.column("doc_id").slice(first, len(sizes)), outside[first:first + len(sizes)], sizes, context, tokens))
            n += len(tokens)
            if n >= size:
                yield whole()
                parts, n = [], 0
    if parts:
        yield whole()


def _gathered(batches: Iterator[pa.RecordBatch], key: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """About ``GATHER`` rows at a time; rows in a run of equal keys stay together."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows < GATHER:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        cut = int(_starts(table, key)[-1]) if key else rows
        kept, rows = ([] if cut == rows else table.slice(cut).to_batches()), rows - cut
        if cut:
            yield table.slice(0, cut)
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles of finished jobs; what listeners still held the first time goes the second."""
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)


def _starts(table: pa.Table, key: tuple[str, ...]) -> np.ndarray:
    """First row of each run of equal keys."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in key:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by bucket (key modulo their number), the buckets that have rows, and where each one's rows begin and the last one's end."""
    bucket = (keys.astype(np.int64) % buckets).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(bucket)), dtype=bool), bucket[1:] != bucket[:-1])))
    return order, bucket[starts].astype(np.int32), np.append(starts, len(bucket))


def _packed(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The numbers from each cut to the next as one binary value."""
    numbers = np.ascontiguousarray(numbers)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * numbers.itemsize).astype(np.int32)), pa.py_buffer(numbers)])


def _unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values in a row, and where those of each value begin and the last one's end."""
    parts = [np.frombuffer(value.as_buffer(), dtype=kind) for value in column]
    return np.concatenate([np.zeros(0, dtype=kind), *parts]), np.cumsum([0, *map(len, parts)])


def _in_buckets(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucket and the columns of ``rows``, many rows a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            order, found, cuts = _dealt(table.column(key).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(found), *[_packed(c.to_numpy()[order], cuts) for c in table.columns]], names=["bucket", *table.column_names])

    return rows.mapInArrow(run, "bucket int" + "".join(f", {c} binary" for c in rows.columns))


def _crowded(docs: DataFrame) -> np.ndarray:
    """The end and the words that fill much of some texts: their pairs are dealt to several tasks. Nothing else depends on it."""
    tokens = [t for _, _, _, t in _read(pa.RecordBatch.from_arrays([docs.select("text").limit(1_000).toArrow().column("text").combine_chunks()], names=["text"]))]
    h, n = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, dtype=np.uint64), np.zeros(0))
    return np.unique(np.append(h[n * 500 >= n.sum()], END))


def _pair_counts(docs: DataFrame, held: Column) -> DataFrame:
    """u, w, c, asked: how often each word follows each other one in the training texts, and if a held-out text has the pair, stored.

    An end stands around each text. Pairs travel in blocks, one for each chunk of texts and bucket of contexts.
    """
    crowded = _crowded(docs)
    # Several buckets a partition, so that a bucket is a small part of what a task may hold.
    buckets = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << 16) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, outside, sizes, _, tokens in _chunks(batches, GATHER):
            words, w = np.unique(tokens, return_inverse=True)
            ends = np.cumsum(sizes) - 1
            u = np.roll(w, 1)
            u[ends + 1 - sizes] = w[ends]                           # a text starts after an end
            seen = np.sort((u << 32) | (w << 1) | np.repeat(outside, sizes))
            first = np.flatnonzero(np.concatenate(([True], seen[1:] >> 1 != seen[:-1] >> 1)))
            # Twice the occurrences in training texts, and 1 for a pair of a held-out text.
            outer = np.add.reduceat(seen & 1, first)
            n = 2 * (np.diff(np.append(first, len(seen))) - outer) + (outer > 0)
            u, w = seen[first] >> 32, words[(seen[first] >> 1) & 0x7FFFFFFF]
            # The pairs of a context lie together, which makes the files short; those of a crowded one lie in sixteen buckets.
            part = np.where(np.isin(words, crowded)[u], w & np.uint64(15), np.uint64(0))
            u = words[u]
            order, found, cuts = _dealt(mix(u + part), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(found), *[_packed(x[order], cuts) for x in (u, w, n)]], names=["bucket", "u", "w", "n"])

    def merged(blocks: pa.Table) -> pa.Table:
        u, w, n = (_unpacked(blocks.column(c), k)[0] for c, k in (("u", np.uint64), ("w", np.uint64), ("n", np.int64)))
        pair = _pair(u, w)
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        c, asked = np.add.reduceat(n >> 1, first), np.bitwise_or.reduceat(n & 1, first) > 0
        known = np.flatnonzero(c > 0)
        u = u[order[first[known]]]
        again = np.argsort(u)                                       # by context
        known, u = known[again], u[again]
        return pa.table({"u": u.astype(np.int64), "w": w[order[first[known]]].astype(np.int64), "c": c[known], "asked": asked[known]})

    return stored(docs.select("doc_id", "text", held.alias("held")).mapInArrow(run, "bucket int, u binary, w binary, n binary").groupBy("bucket").applyInArrow(
        merged, "u bigint, w bigint, c bigint, asked boolean"))


@dataclass
class Root:
    """The restaurant of all words: its discount, each known word's share of the base and the unknown's, and tables after the last draw."""

    discount: float
    base: float
    unknown: float
    tables: list[int]
    turn: int = 0

    def draw(self, words: DataFrame, customers: list[str]) -> tuple[DataFrame, list[int]]:
        """h and the tables ``_t<i>`` of each word for each column of customers, and what opened them; the root is left with the new totals."""
        self.turn += 1
        d, turn = self.discount, self.turn
        before = (self.tables * len(customers))[:len(customers)]
        opening = [(STRENGTH + d * t) * self.base for t in before]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _gathered(batches):
                h = table.column("h").to_numpy()
                own = [table.column(c).to_numpy() for c in customers]
                drawn = [seat(c, np.full(len(c), a), d, h.astype(np.uint64), 101 * turn + i) for i, (c, a) in enumerate(zip(own, opening, strict=True))]
                yield _batch(h=h, **{f"_c{i}": c.astype(np.int64) for i, c in enumerate(own)}, **{f"_t{i}": t for i, t in enumerate(drawn)})

        places = range(len(customers))
        seated = words.select("h", *customers).mapInArrow(
            run, ", ".join(["h bigint", *[f"_c{i} bigint" for i in places], *[f"_t{i} bigint" for i in places]]))
        sums = seated.agg(*[F.sum(f"_c{i}") for i in places], *[F.sum(f"_t{i}") for i in places]).first()
        self.tables = [x or 0 for x in sums[len(customers):]]
        return seated, [x or 0 for x in sums[:len(customers)]]

    def probabilities(self, words: DataFrame, customers: list[str]) -> tuple[DataFrame, float]:
        """h, r (probability at the root, averaged over the columns) of each word, and the unknown word's.

        Both use the tables of one draw and their own total, so that they add up to 1.
        """
        seated, n = self.draw(words, customers)
        d, base, unknown = self.discount, self.base, self.unknown
        each = [(F.col(f"_c{i}") - d * F.col(f"_t{i}") + (STRENGTH + d * t) * base) / (STRENGTH + n[i]) for i, t in enumerate(self.tables)]
        outside = [(STRENGTH + d * t) * unknown / (STRENGTH + n[i]) for i, t in enumerate(self.tables)]
        return seated.select("h", (sum(each[1:], each[0]) / len(each)).alias("r")), sum(outside) / len(outside)


def _root_of(words: DataFrame) -> Root:
    """The root with one table for each word. The unknown get as much as the words seen in one context say new words are worth."""
    v, ones, twos = (x or 0 for x in words.agg(F.count(F.lit(1)), F.count_if(F.col("as_word") == 1), F.count_if(F.col("as_word") == 2)).first())
    d = discount_of(ones, twos)
    unknown = float(np.clip(ones / (d * v + STRENGTH), 0.05, 0.95)) if v else 1.0
    return Root(d, (1 - unknown) / max(1, v), unknown, [v])


def _sweeps(seats: DataFrame, roots: DataFrame, d: float, turn: int, sweeps: int, keep: int) -> DataFrame:
    """``seats`` with the tables ``t0`` on of its last ``keep`` of some sweeps, stored.

    ``seats`` has u, part, w, c, single, t and fixed: the tables of the same restaurant that are not in this part. A part is seated in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, ("u", "part")):
            u, part, w, c, single, t, fixed, r = (table.column(x).to_numpy() for x in ("u", "part", "w", "c", "single", "t", "fixed", "r"))
            starts = _starts(table, ("u", "part"))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(u))))
            key, drawn = _pair(u.astype(np.uint64), w.astype(np.uint64)), []
            for sweep in range(sweeps):
                opening = (STRENGTH + d * (np.add.reduceat(t, starts) + fixed[starts]))[group] * r
                t = seat(c, opening, d, key, turn + sweep)
                drawn.append(t)
            yield _batch(u=u, part=part, w=w, c=c, single=single, **{f"t{i}": x for i, x in enumerate(drawn[sweeps - keep:])})

    met = seats.join(roots.withColumnRenamed("h", "_h").hint("shuffle_hash"), F.col("w") == F.col("_h")).drop("_h")
    out = stored(met.repartition("u", "part").sortWithinPartitions("u", "part").mapInArrow(
        run, ", ".join(["u bigint, part int, w bigint, c bigint, single bigint", *[f"t{i} bigint" for i in range(keep)]])))
    _release(seats.sparkSession)
    return out


@tidied
def _seated(pairs: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, float, float]:
    """Tables of the pairs that occur repeatedly (others have one), and probabilities of all words.

    Returns u, w, c, t (tables, averaged over the samples); h, c, r (probability at the root), share (strength and discounts
    of the word's restaurant) for each word; the discount; the unknown word's probability at the root.
    """
    ones, twos = pairs.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    d, root = discount_of(ones, twos), _root_of(words)
    # Pairs that occur once have one table each; single: how many of them a context, once: how many of them a word has.
    halls = words.filter(F.col("many") > 0).select(F.col("h").alias("_h"), "many", (F.col("as_context") - F.col("many")).alias("single"))
    seats = stored(pairs.filter(F.col("c") > 1).join(halls.hint("shuffle_hash"), F.col("u") == F.col("_h")).select(
        "u", F.pmod(F.xxhash64("w"), F.ceil(F.col("many") / PART)).cast("int").alias("part"), "w", "c", "single"))

    def fixed(tables: DataFrame, name: str) -> DataFrame:
        """``tables`` with those of the restaurant's other parts and single pairs; only restaurants in parts need the others' sums."""
        split = halls.filter(F.col("many") > PART).select(F.col("_h").alias("u"))
        sums = tables.join(F.broadcast(split), "u", "left_semi").groupBy("u", "part").agg(F.sum(name).alias("_own"))
        whole = sums.groupBy("u").agg(F.sum("_own").alias("_all"))
        others = sums.join(whole, "u").select(F.col("u").alias("_u"), F.col("part").alias("_part"), (F.col("_all") - F.col("_own")).alias("_others"))
        return tables.join(F.broadcast(others), (F.col("u") == F.col("_u")) & (F.col("part") == F.col("_part")), "left").withColumn(
            "fixed", F.col("single") + F.coalesce("_others", F.lit(0))).drop("_u", "_part", "_others")

    def customers(tables: DataFrame, names: list[str]) -> DataFrame:
        """h and the root's customers: tables of each word in all contexts."""
        sums = tables.groupBy("w").agg(*[F.sum(n).alias(n) for n in names])
        return stored(words.join(sums, F.col("h") == F.col("w"), "left").select("h", *[(F.col("once") + F.coalesce(n, F.lit(0))).alias(n) for n in names]))

    for _ in range(BURN_IN - 1):
        root.draw(words, ["as_word"])
    roots, _ = root.probabilities(words, ["as_word"])
    tables = _sweeps(fixed(seats.withColumn("t", F.lit(1).cast("long")), "t"), roots, d, 1_000, BURN_IN, 1)
    at_root = customers(tables, ["t0"])
    for _ in range(BURN_IN - 1):
        root.draw(at_root, ["t0"])
    roots, _ = root.probabilities(at_root, ["t0"])
    tables = tables.withColumnRenamed("t0", "t")
    names = [f"t{i}" for i in range(SAMPLES)]
    tables = _sweeps(fixed(tables, "t"), roots, d, 2_000, SAMPLES, SAMPLES)
    roots, unknown = root.probabilities(customers(tables, names), names)
    mean = (sum((F.col(n) for n in names[1:]), F.col(names[0])) / SAMPLES).alias("t")
    tables = tables.select("u", "w", "c", mean)
    every = words.join(roots.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h")).drop("_h").join(
        tables.groupBy("u").agg(F.sum("t").alias("t")), F.col("h") == F.col("u"), "left")
    every = stored(every.select("h", "c", "r", (STRENGTH + d * (F.col("as_context") - F.col("many") + F.coalesce("t", F.lit(0.0)))).alias("share")))
    return tables, every, d, unknown


def _words_of(pairs: DataFrame) -> DataFrame:
    """h, c (occurrences), as_context and as_word (pairs it is in), many (of the first, those that occur repeatedly), once (of the second, those that do not), stored.

    Each word is a context as often as it occurs, an end included.
    """
    own = pairs.groupBy(F.col("u").alias("_u")).agg(F.count(F.lit(1)).alias("as_context"), F.count_if(F.col("c") > 1).alias("many"))
    met = pairs.groupBy(F.col("w").alias("h")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("as_word"), F.count_if(F.col("c") == 1).alias("once"))
    return stored(met.join(own, F.col("h") == F.col("_u")).drop("_u"))


def _frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the highest ``c``, at most so many: all that reach a number of occurrences."""
    sizes = sorted(((r["c"], r["n"]) for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, most
    for c, n in sizes:
        room -= n
        if room < 0:
            break
        least = c
    return rows.filter(F.col("c") >= least) if least is not None else rows.filter(F.lit(False))


@tidied
def _learnt(docs: DataFrame, held: Column) -> tuple[DataFrame, DataFrame, float, float]:
    """What the scores need, learned from the texts that are not held out.

    Returns pair, c, one and none (log10 probability, less that of a pair that occurs once and of one that does not) of the pairs
    that occur repeatedly, or once and in a held-out text as well; the words, the discount and the unknown word's probability
    at the root as :func:`_seated`.
    """
    pairs = _pair_counts(docs, held)
    _release(docs.sparkSession)
    counts = _words_of(pairs)
    _release(docs.sparkSession)
    tables, words, d, unknown = _seated(pairs, counts)
    met = pairs.filter((F.col("c") == 1) & F.col("asked")).select("u", "w", "c", F.lit(1.0).alias("t"))
    context, word = words.select(F.col("h").alias("u"), F.col("c").alias("n"), "share"), words.select(F.col("h").alias("w"), "r")
    p = lambda c, t: F.log10((c - d * t + F.col("share") * F.col("r")) / (STRENGTH + F.col("n")))
    own = p(F.col("c"), F.col("t"))
    gains = tables.unionByName(met).join(context.hint("shuffle_hash"), "u").join(word.hint("shuffle_hash"), "w").select(
        _pair_of(F.col("u"), F.col("w")).alias("pair"), "c", (own - p(F.lit(1), F.lit(1))).alias("one"), (own - p(F.lit(0), F.lit(0))).alias("none"))
    return stored(gains), words, d, unknown


REPLY = "chunk bigint, places binary, sums binary, c binary, r binary, share binary"


def _replies(asks: DataFrame, known: DataFrame, answer: Callable[[pa.Table, pa.Table], list[pa.Array]], names: list[str]) -> DataFrame:
    """Rows of ``REPLY``: what ``answer`` makes of the blocks asked in each bucket and of the rows known there, one for each block, without those of no place."""

    def run(asks: pa.Table, known: pa.Table) -> pa.Table:
        columns = dict(zip(names, answer(asks, known), strict=True)) if len(asks) else {}
        empty = pa.nulls(len(asks), pa.binary())
        return pa.table({"chunk": asks.column("chunk"), **{c: columns.get(c, empty) for c in ("places", "sums", "c", "r", "share")}})

    met = asks.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, REPLY)
    return met.filter(F.length("places") > 0)


def _sorted(known: pa.Table, key: str, columns: tuple[str, ...]) -> tuple[Finder, list[np.ndarray]]:
    """A finder of the keys, and the columns (floating point) in their order."""
    keys = _unpacked(known.column(key), np.uint64)[0]
    order = np.argsort(keys)
    return Finder(keys[order]), [_unpacked(known.column(c), np.float64)[0][order] for c in columns]


def _sums(asks: pa.Table, known: pa.Table) -> list[pa.Array]:
    """Texts of each block that have pairs known here, and the sums of what their occurrences add."""
    finder, (one, none) = _sorted(known, "pair", ("one", "none"))
    numbers, cuts = _unpacked(asks.column("numbers"), np.uint64)
    steps = np.cumsum(_unpacked(asks.column("places"), np.int32)[0], dtype=np.int64)
    # Each block counts from 0.
    asked = steps - np.repeat(np.concatenate(([0], steps))[cuts[:-1]], np.diff(cuts))
    at = finder.find(numbers)
    kept = np.flatnonzero(at >= 0)
    value = np.where(asked[kept] & 1, none[at[kept]], one[at[kept]])
    block, text = np.repeat(np.arange(len(asks)), np.diff(cuts))[kept], asked[kept] >> 1
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(kept)), dtype=bool), (block[1:] != block[:-1]) | (text[1:] != text[:-1]))))
    own = np.searchsorted(block[starts], np.arange(len(asks) + 1))
    sums = np.add.reduceat(value, starts) if len(starts) else value
    return [_packed(text[starts].astype(np.int32), own), _packed(sums, own)]


def _known_words(asks: pa.Table, known: pa.Table) -> list[pa.Array]:
    """Places of each block's words that are known here, and their numbers."""
    finder, columns = _sorted(known, "h", ("c", "r", "share"))
    numbers, cuts = _unpacked(asks.column("numbers"), np.uint64)
    places, at = _unpacked(asks.column("places"), np.int32)[0], finder.find(numbers)
    kept = np.flatnonzero(at >= 0)
    own = np.searchsorted(kept, cuts)
    return [_packed(places[kept], own), *[_packed(c[at[kept]], own) for c in columns]]


@tidied
def _read_and_found(docs: DataFrame, held: Column) -> tuple[DataFrame, DataFrame, Broadcast, tuple[int, int], float, float]:
    """:func:`_read_texts` and the replies to its blocks, the lookup, the numbers of training tokens and words, the discount and the unknown's probability."""
    gains, words, d, unknown = _learnt(docs, held)
    _release(docs.sparkSession)
    total, kinds = (x or 0 for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    buckets = min(max(16, total >> 20), (1 << 16) - 1)
    lookup = docs.sparkSession.sparkContext.broadcast(_lookup(words))
    parts = _read_texts(docs, held, lookup, _frequent(gains, DISHES).select("pair", "one", "none").toArrow(), d, buckets)
    blocks = parts.select("chunk", "kind", "bucket", "numbers", "places")
    double = [F.col(c).cast("double").alias(c) for c in ("c", "r", "share")]
    asked = blocks.filter(F.col("kind") == WORDS)
    # Blocks are long rows, of which few are read at a time.
    with _set(docs.sparkSession, "spark.sql.parquet.columnarReaderBatchSize", "512"):
        replies = [stored(_replies(asked, _in_buckets(words.select("h", *double), "h", buckets), _known_words, ["places", "c", "r", "share"]))]
        _release(docs.sparkSession)
        for turn in range(ROUNDS):
            asked = blocks.filter((F.col("kind") == PAIRS) & (F.col("bucket") % ROUNDS == turn))
            share = gains.filter(F.pmod("pair", F.lit(buckets)) % ROUNDS == turn)
            replies.append(stored(_replies(asked, _in_buckets(share.select("pair", "one", "none"), "pair", buckets), _sums, ["places", "sums"])))
            _release(docs.sparkSession)
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    return parts.filter(F.col("kind") == TEXTS), every, lookup, (total, kinds), d, unknown


def score_texts(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``docs``.

    The model learns from the texts outside the held-out fold. Null texts are
    empty and hold the end alone. Texts are read whole. Repeated rows and null
    ids keep their rows. Without training texts every word is unknown.
    """
    # Rows of numbers; those of texts are bounded by their bytes.
    with _set(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "50000"):
        parts, replies, lookup, (total, kinds), d, unknown = _read_and_found(docs, fold_of(F.col("doc_id"), folds) == held)

    def whole(parts: pa.Table, replies: pa.Table) -> pa.Table:
        words = lookup.value
        found = {c: _unpacked(parts.column(c), k)[0] for c, k in PACKED.items()}
        base, score, known = found["base"].copy(), found["score"].copy(), found["known"].copy()
        n, texts = len(base), np.cumsum(found["far_text"], dtype=np.int64)
        u, w = found["far_u"].astype(np.int64), found["far_w"].astype(np.int64)
        # Places of words behind the lookup are counted down from -1; words without a reply are unknown.
        size = -min(u.min(initial=0), w.min(initial=0))
        c, r, share = np.zeros(size), np.full(size, unknown), np.full(size, STRENGTH)
        of_words = replies.filter(pc.is_valid(replies.column("c")))
        at = _unpacked(of_words.column("places"), np.int32)[0]
        for all_, name in ((c, "c"), (r, "r"), (share, "share")):
            all_[at] = _unpacked(of_words.column(name), np.float64)[0]
        c, r, share = (np.concatenate((x, y[::-1])) for x, y in ((words.counts, c), (words.roots, r), (words.shares, share)))
        outside = found["held"][texts]
        score += np.bincount(texts, np.log10((np.where(outside, 0.0, 1 - d) + share[u] * r[w]) / (STRENGTH + c[u])), n)
        new = np.flatnonzero(w < 0)
        base += np.bincount(texts[new], np.log10(c[w[new]] + 0.1), n)
        known += np.bincount(texts[new], c[w[new]] > 0, n).astype(np.int64)
        of_pairs = replies.filter(pc.is_valid(replies.column("sums")))
        score += np.bincount(_unpacked(of_pairs.column("places"), np.int32)[0], _unpacked(of_pairs.column("sums"), np.float64)[0], n)
        ids = parts.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(found["held"]), pa.array(found["sizes"]), pa.array(known), pa.array(base), pa.array(score)],
                        names=["doc_id", "held", "n_tokens", "n_known", "base", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = parts.select("chunk", "ids", *PACKED).groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        whole, f"doc_id {kind}, held boolean, n_tokens bigint, n_known bigint, base double, score double")
    scale = float(np.log10(total + 0.1 * (kinds + 1)))
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * scale).alias("base_score"),
                      "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _lookup(vocabulary: DataFrame) -> Lookup:
    """The most frequent words with their counts, probabilities at the root and shares."""
    top = _frequent(vocabulary, LOOKUP).toArrow()
    h = top.column("h").to_numpy().astype(np.uint64)
    order = np.argsort(h)
    return Lookup(h[order], *[top.column(c).to_numpy()[order].astype(np.float64) for c in ("c", "r", "share")])


# Kinds of rows of what is read: the texts of a chunk, and the words and pairs of a chunk that are looked up in one bucket.
TEXTS, WORDS, PAIRS = range(3)
PACKED = {"held": np.bool_, "sizes": np.int64, "known": np.int64, "base": np.float64, "score": np.float64,
          "far_text": np.int32, "far_u": np.int32, "far_w": np.int32}


def _read_texts(docs: DataFrame, held: Column, shared: Broadcast, top: pa.Table, d: float, buckets: int) -> DataFrame:
    """Chunks of texts with what the broadcast tables know of them, and blocks of what is asked for, stored.

    A pair of words of the lookup is in its text's score as if it occurred once in training texts, or not if the text is held out; the
    pairs of the broadcast table add the rest. All others are asked for: ``numbers``, and ``places`` as steps of twice the text's place, with 1 for
    a held-out one. Words behind the lookup are asked for once a chunk, and the pairs that they are in kept as ``far_text`` (in steps), ``far_u`` and ``far_w``.
    """
    pair = top.column("pair").to_numpy().astype(np.uint64)
    order = np.argsort(pair)
    frequent = docs.sparkSession.sparkContext.broadcast((pair[order], *[top.column(c).to_numpy()[order] for c in ("one", "none")]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(chunk: int, of: int, n: int, ids: pa.Array, **columns: pa.Array) -> pa.RecordBatch:
        every = {"chunk": pa.array(np.full(n, chunk)), "kind": pa.array(np.full(n, of, dtype=np.int32)), "bucket": pa.nulls(n, pa.int32()), "ids": ids,
                 **{c: pa.nulls(n, pa.binary()) for c in ("numbers", "places", *PACKED)}} | columns
        return pa.RecordBatch.from_arrays(list(every.values()), names=list(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, (top, one, none) = shared.value, frequent.value
        known, frequents = Finder(lookup.hashes), Finder(top)
        weights = np.log10(lookup.counts + 0.1)
        chunk = TaskContext.get().partitionId() << 33
        for ids, outside, sizes, context, tokens in _chunks(batches, CHUNK):
            n, ends = len(sizes), np.cumsum(sizes) - 1
            starts = ends + 1 - sizes
            text = np.repeat(np.arange(n, dtype=np.int32), sizes)
            away = outside[text]
            w = known.find(tokens)
            behind = np.flatnonzero(w < 0)
            new, place = np.unique(tokens[behind], return_inverse=True)
            w[behind] = -1 - place
            u = np.roll(w, 1)
            u[starts] = w[ends]                                     # a text starts after an end
            near = (u >= 0) & (w >= 0)
            base, score = np.zeros(len(tokens)), np.zeros(len(tokens))
            base[w >= 0] = weights[w[w >= 0]]
            on, of = u[near], w[near]
            score[near] = np.log10((np.where(away[near], 0.0, 1 - d) + lookup.shares[on] * lookup.roots[of]) / (STRENGTH + lookup.counts[on]))
            numbers = _pair(context, tokens)
            at = frequents.find(numbers)
            met = np.flatnonzero(at >= 0)
            score[met] += np.where(away[met], none[at[met]], one[at[met]])
            far = np.flatnonzero(~near)
            own = {"held": outside, "sizes": sizes, "known": np.add.reduceat(w >= 0, starts, dtype=np.int64), "base": np.add.reduceat(base, starts),
                   "score": np.add.reduceat(score, starts), "far_text": np.diff(text[far], prepend=0), "far_u": u[far], "far_w": w[far]}
            yield rows(chunk, TEXTS, 1, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                       **{c: _packed(x.astype(PACKED[c]), np.array([0, len(x)])) for c, x in own.items()})
            nobody = pa.nulls(0, ids.type)
            order, bucket, cuts = _dealt(new, buckets)
            yield rows(chunk, WORDS, len(bucket), pa.ListArray.from_arrays(pa.array(np.zeros(len(bucket) + 1, dtype=np.int32)), nobody),
                       bucket=pa.array(bucket), numbers=_packed(new[order], cuts), places=_packed(order.astype(np.int32), cuts))
            asked = np.flatnonzero(at < 0)
            order, bucket, cuts = _dealt(numbers[asked], buckets)
            asked = asked[order]
            whose = 2 * text[asked] + away[asked]
            step = np.diff(whose, prepend=0)
            step[cuts[:-1]] = whose[cuts[:-1]]
            yield rows(chunk, PAIRS, len(bucket), pa.ListArray.from_arrays(pa.array(np.zeros(len(bucket) + 1, dtype=np.int32)), nobody),
                       bucket=pa.array(bucket), numbers=_packed(numbers[asked], cuts), places=_packed(step.astype(np.int32), cuts))
            chunk += n

    return stored(docs.select("doc_id", "text", held.alias("held")).mapInArrow(
        run, f"chunk bigint, kind int, bucket int, ids array<{kind}>" + "".join(f", {c} binary" for c in ("numbers", "places", *PACKED))))
