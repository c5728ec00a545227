"""Toxic spans by a linear-chain conditional random field.

Tokens get their labels from labelled documents: words, or beginnings of words,
that occur in toxic documents far more often than chance allows mark the tokens
of toxic documents; every other token is clean. A two-state chain is trained on
sentences of these tokens. Scoring runs forward-backward over every sentence of
every text; the marginals give a document's score and its offending offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import fold_of, hash31, stored
from traceaudit.llm.quality import training_rows
from traceaudit.llm.shingles import Bytes, pieces, word_edges

# Labelled documents of one class, cues, training sentences and their tokens: the bounds of what a fit reads.
CLASS_ROWS = 4_000
CUES = 5_000
SENTENCES = 12_000
SENTENCE_TOKENS = 60

# Tokens are runs of letters, marks, digits and underscores, for cues, training and scoring alike; sentences end at these marks.
TOKEN_CLASS = r"[\p{L}\p{M}\p{N}_]"
TOKEN = regex.compile(TOKEN_CLASS + "+")
STOPS = ".!?\n\u3002\uff01\uff0e\uff1f\uff61"
SENTENCE = regex.compile(f"[{STOPS}]+")
BETWEEN = np.array([b < 128 and not (chr(b).isalnum() or chr(b) == "_") for b in range(256)])
BREAK = np.array([b < 128 and chr(b) in STOPS for b in range(256)])
# Features of a token: a mark and the letters that it takes, from the start or, negative, from the end; 0 takes the word.
PARTS = (("w=", 0), ("p=", 4), ("q=", 5), ("r=", 6), ("s=", -3))
# Marginals below this are not summed in a document's score: thousands of clean tokens would add up.
LEAST_MARGINAL = 0.1


def _beyond_tokens() -> np.ndarray:
    """For each code point its stand-in byte if it is no part of a token: a stop, a blank, or 0 for parts of tokens."""
    table = np.full(0x110000, 0x20, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    inside = "".join(regex.findall(TOKEN_CLASS, every))
    table[np.frombuffer(inside.encode("utf-32-le"), dtype="<u4")] = 0
    table[[ord(c) for c in STOPS]] = ord(".")
    return table


_STAND_IN: list[np.ndarray] = []


def plain_breaks(data: np.ndarray) -> np.ndarray:
    """The bytes with every character beyond ASCII that is no part of a token overwritten by blanks, or by stops if it ends a sentence."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return data
    if not _STAND_IN:
        _STAND_IN.append(_beyond_tokens())
    width = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    code = (data[lead] & (0x7F >> width)).astype(np.int64)
    for k in range(1, 4):
        more = width > k
        code[more] = (code[more] << 6) | (data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F)
    other = _STAND_IN[0][np.minimum(code, 0x10FFFF)]
    out, change = data.copy(), other > 0
    for k in range(4):
        here = change & (width > k)
        out[np.minimum(lead[here] + k, len(data) - 1)] = other[here]
    return out


def features(word: str) -> tuple[str, ...]:
    """Features of a token: the word, its beginnings and its end."""
    return tuple(mark + (word[:n] if n > 0 else word[n:] if n else word) for mark, n in PARTS)


@dataclass
class Chain:
    """Weights of the features for a toxic token, and of the four transitions (from clean, from toxic)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    intercept: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per kind of feature the sorted hashes of its values and their weights."""
        out = []
        for mark, _ in PARTS:
            found = {f[len(mark):]: w for f, w in self.weights.items() if f.startswith(mark)}
            data = [f.encode() for f in found]
            stop = np.cumsum([len(d) for d in data], dtype=np.int64)
            hashes = np.zeros(0, dtype=np.uint64)
            if len(stop):
                hashes = Bytes(np.frombuffer(b"".join(data), dtype=np.uint8)).hashes(np.concatenate(([0], stop[:-1])), stop - 1)
            order = np.argsort(hashes)
            out.append((hashes[order], np.array(list(found.values()), dtype=float)[order]))
        return out


def emissions(data: np.ndarray, known: Bytes, start: np.ndarray, stop: np.ndarray, chain: Chain, tables: list) -> np.ndarray:
    """Emission of each token, its features looked up by the hashes of its bytes."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)              # where characters begin
    first, last = np.searchsorted(heads, start, "right") - 1, np.searchsorted(heads, stop, "right") - 1
    heads = np.append(heads, len(data))
    out = np.full(len(start), chain.bias)
    for (_, n), (hashes, weights) in zip(PARTS, tables, strict=True):
        if len(hashes):
            begin = heads[np.maximum(first, last + 1 + n)] if n < 0 else start
            end = heads[np.minimum(first + n, last + 1)] - 1 if n > 0 else stop
            mine = known.hashes(begin, end)
            spot = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
            out += np.where(hashes[spot] == mine, weights[spot], 0.0)
    return out


def _odds(emissions: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state by the token itself, by all up to it, and by all after it."""
    m00, m01, m10, m11 = np.exp(moves)
    own = np.exp(np.clip(emissions, -30, 30))
    ahead, back = np.empty_like(own), np.ones_like(own)
    ahead[0] = own[0]
    for t in range(1, len(own)):
        a = ahead[t - 1]
        ahead[t] = own[t] * (m01 + m11 * a) / (m00 + m10 * a)
    for t in range(len(own) - 2, -1, -1):
        x = own[t + 1] * back[t + 1]
        back[t] = (m10 + m11 * x) / (m00 + m01 * x)
    return own, ahead, back


def marginals(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each place; ``emissions`` is (places, sentences)."""
    _, ahead, back = _odds(emissions, moves)
    joint = ahead * back
    return joint / (1 + joint)


def sentence_marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of each token; the sentences, of at least one token each, follow one another.

    All sentences go on together, the longest first, so that a step works on those that reach its place.
    """
    m00, m01, m10, m11 = np.exp(moves)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    steps = int(lengths.max())
    reach = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")     # sentences with a token at each place
    off = np.concatenate(([0], np.cumsum(reach)))
    sentence = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(emissions)) - (np.cumsum(lengths) - lengths)[sentence]
    spot = off[place] + rank[sentence]
    own = np.empty_like(emissions)
    own[spot] = np.exp(np.clip(emissions, -30, 30))
    ahead, back = own.copy(), np.ones_like(own)
    for t in range(1, steps):
        n, here, last = reach[t], off[t], off[t - 1]
        a = ahead[last:last + n]
        ahead[here:here + n] *= (m01 + m11 * a) / (m00 + m10 * a)
    for t in range(steps - 2, -1, -1):
        n, here, after = reach[t + 1], off[t], off[t + 1]
        x = own[after:after + n] * back[after:after + n]
        back[here:here + n] = (m10 + m11 * x) / (m00 + m01 * x)
    joint = ahead * back
    return (joint / (1 + joint))[spot]


def _padded(values: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sentences of equal length at a time: their numbers, and their values as (places, sentences)."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        n = lengths[group[0]]
        if n:
            yield group, values[starts[group][None, :] + np.arange(n)[:, None]]


def _tokens_of(text: str) -> list[list[str]]:
    return [words for part in SENTENCE.split(text.lower()) if (words := TOKEN.findall(part))]


def score_texts(texts: pa.Array, chain: Chain) -> Iterator[tuple[float, float, list[tuple[int, int]]]]:
    """(largest marginal's log odds, log of 1 + the sum of marginals above 0.1, offending spans) of each text.

    Spans are code point offsets of neighbouring tokens whose marginal is one half
    or more.
    """
    moves, tables = np.array(chain.moves), chain.tables()
    for at, to, raw, ends in pieces(pc.utf8_lower(texts)):
        n = to - at
        top, total, spans = np.full(n, -30.0), np.zeros(n), [[] for _ in range(n)]
        data = plain_breaks(raw)
        start, stop = word_edges(data, ends, BETWEEN) if len(data) else (np.zeros(0, dtype=np.int64),) * 2
        if len(start):
            known = Bytes(data)
            _, one, which = np.unique(known.hashes(start, stop), return_index=True, return_inverse=True)
            weights = emissions(data, known, start[one], stop[one], chain, tables)
            owner = np.searchsorted(ends, start, side="right")
            part = np.cumsum(BREAK[data])[start]
            begins = np.concatenate(([0], np.flatnonzero((np.diff(part) != 0) | (np.diff(owner) != 0)) + 1))
            own = owner[begins]
            m = sentence_marginals(weights[which], np.diff(np.append(begins, len(start))), moves)
            most = np.maximum.reduceat(m, begins)
            np.maximum.at(top, own, np.log(np.clip(most, 1e-13, 1)) - np.log(np.clip(1 - most, 1e-13, 1)))
            total += np.bincount(owner, weights=np.where(m > LEAST_MARGINAL, m, 0.0), minlength=n)
            for text, first, last in _spans(m, owner, begins, start, stop, raw, ends):
                spans[text].append((first, last))
        for i in range(n):
            yield float(top[i]), float(np.log1p(total[i])), spans[i]


def _spans(m: np.ndarray, owner: np.ndarray, begins: np.ndarray, start: np.ndarray, stop: np.ndarray, raw: np.ndarray,
           ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, first code point, code point after the last) of the offending tokens, neighbours in a sentence merged.

    Lower case has as many code points as the text itself.
    """
    bad = np.flatnonzero(m >= 0.5)
    if not len(bad):
        return
    sentence = np.searchsorted(begins, bad, side="right")
    joined = (np.diff(bad) == 1) & (np.diff(sentence) == 0)
    first, last = bad[np.append(True, ~joined)], bad[np.append(~joined, True)]
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    text = owner[first]
    base = chars[np.concatenate(([0], ends[:-1]))[text]]
    yield from zip(text.tolist(), (chars[start[first]] - base).tolist(), (chars[stop[last] + 1] - base).tolist(), strict=True)


def _evidence(docs: DataFrame, chain: Chain) -> DataFrame:
    """Columns of ``docs`` (doc_id first, text second, any others after) with top, total and spans in place of the text."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", top double, total double, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(score_texts(batch.column("text"), chain))
            columns = [batch.column(c) for c in kept] + [
                pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([",".join(f"{a}:{b}" for a, b in f[2]) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "top", "total", "spans"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def cues(rows: DataFrame, limit: int = CUES) -> set[str]:
    """Words and beginnings that mark toxic documents.

    ``rows`` has text, label and weight. A cue is in at least 4 toxic documents,
    and its share of toxic documents is at least 15 times that of clean ones.
    """
    words = F.expr(r"array_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+', 0))")
    parts = F.expr("""array_distinct(flatten(transform(_words, w -> array(concat('w=', w), concat('p=', left(w, 4)),
        concat('q=', left(w, 5)), concat('r=', left(w, 6))))))""")
    each = rows.select("label", words.alias("_words")).select("label", F.explode(parts).alias("cue"))
    sums = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sums.get(1.0, 0), sums.get(0.0, 0)
    if not toxic or not clean:
        return set()
    counted = each.groupBy("cue").agg(F.sum("label").alias("_in"), F.sum(1 - F.col("label")).alias("_out"))
    ratio = (F.col("_in") / toxic) / ((F.col("_out") + 0.5) / clean)
    best = counted.filter((F.col("_in") >= 4) & (ratio >= 15) & (F.length("cue") >= 6)).orderBy(F.desc("_in"), "cue").limit(limit)
    return {r["cue"] for r in best.collect()}


def labelled_sentences(rows: DataFrame, marks: set[str], limit: int = SENTENCES) -> list[tuple[list[str], list[int]]]:
    """Training sentences as tokens and token labels, at most ``limit``: half with a marked token, half without.

    Longer sentences are cut into pieces of ``SENTENCE_TOKENS`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[list[str], list[int], int]] = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for words in _tokens_of(text or ""):
                    for i in range(0, len(words), SENTENCE_TOKENS):
                        piece = words[i:i + SENTENCE_TOKENS]
                        tags = [int(label == 1.0 and not marks.isdisjoint(features(w))) for w in piece]
                        out.append((piece, tags, max(tags)))
            for i in range(0, len(out), 5_000):
                part = out[i:i + 5_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], t) for k, t in (
                    (0, pa.list_(pa.string())), (1, pa.list_(pa.int32())), (2, pa.int32()))], names=["words", "tags", "marked"])

    pieces = rows.select("text", "label").mapInArrow(run, "words array<string>, tags array<int>, marked int")
    order = [hash31(F.lit("sentence"), F.concat_ws(" ", "words")), F.concat_ws(" ", "words"), F.concat_ws(" ", F.col("tags").cast("array<string>"))]
    marked = pieces.filter("marked = 1").orderBy(*order).limit(limit // 2)
    plain = pieces.filter("marked = 0").orderBy(*order).limit(limit // 2)
    return [(r["words"], r["tags"]) for r in marked.unionByName(plain).collect()]


def fit_chain(sentences: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.3, l2: float = 1e-4) -> Chain:
    """Maximise the conditional likelihood of the labels by Adam on a bounded number of sentences."""
    counts: dict[str, int] = {}
    for words, _ in sentences:
        for w in words:
            for f in features(w):
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(f for f, n in counts.items() if n >= 3)}
    width = len(features("x"))
    bias = len(names)
    ids, tags, lengths = [], [], np.array([len(w) for w, _ in sentences])
    for words, labels in sentences:
        ids.extend([[names.get(f, bias + 1) for f in features(w)] for w in words])
        tags.extend(labels)
    if not ids or not any(tags):
        return Chain()
    feats, gold = np.array(ids).reshape(-1, width), np.array(tags, dtype=float)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    theta, moves = np.zeros(bias + 2), np.zeros(4)
    theta[bias] = -4.0
    blocks = [(g, starts[g][None, :] + np.arange(lengths[g[0]])[:, None]) for g, _ in _padded(gold, lengths)]
    state = [np.zeros(bias + 6), np.zeros(bias + 6)]
    for step in range(1, rounds + 1):
        emission = theta[feats].sum(axis=1) + theta[bias]
        slope, turn = np.zeros_like(gold), np.zeros(4)
        for _, at in blocks:
            one, pair = _expected(emission[at], moves)
            slope[at] = gold[at] - one
            if len(at) > 1:
                y, z = gold[at][:-1], gold[at][1:]
                turn += np.array([((1 - y) * (1 - z)).sum(), ((1 - y) * z).sum(), (y * (1 - z)).sum(), (y * z).sum()]) - pair
        grad = np.zeros(bias + 6)
        grad[:bias + 2] = np.bincount(feats.ravel(), weights=np.repeat(slope, width), minlength=bias + 2)
        grad[bias] = slope.sum()
        grad[bias + 1] = 0.0
        grad[bias + 2:] = turn
        full = np.concatenate((theta, moves))
        grad = grad / len(sentences) - l2 * full
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad ** 2
        full += rate * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.99 ** step)) + 1e-8)
        theta, moves = full[:bias + 2], full[bias + 2:]
        theta[bias + 1] = 0.0
        rate *= 0.985
    return Chain({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-4}, float(theta[bias]), tuple(float(x) for x in moves))


def _expected(emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state and the expected number of each transition."""
    own, ahead, back = _odds(emission, moves)
    joint = ahead * back
    m, a, x = np.exp(moves), ahead[:-1], (own * back)[1:]
    cells = np.stack([np.full_like(a, m[0]), m[1] * x, m[2] * a, m[3] * a * x])
    return joint / (1 + joint), (cells / cells.sum(axis=0)).sum(axis=(1, 2))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, class_rows: int = CLASS_ROWS) -> Chain:
    """Cues, chain and calibration from labelled documents outside the held-out fold."""
    rows = stored(training_rows(docs, labels, label, folds, class_rows).repartition(8))
    chain = fit_chain(labelled_sentences(rows, cues(rows)))
    seen = rows.select("doc_id", "text", "label", "weight")
    evidence = stored(_evidence(seen, chain))
    if evidence.select("label").distinct().count() == 2:
        data = VectorAssembler(inputCols=["top", "total"], outputCol="_v").transform(evidence)
        fitted = LogisticRegression(featuresCol="_v", labelCol="label", weightCol="weight", regParam=0.001, maxIter=60).fit(data)
        chain.intercept, chain.slopes = float(fitted.intercept), tuple(float(x) for x in fitted.coefficients)
    return chain


def with_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, score, spans (``start:end`` in code points, comma-joined) for every row of ``docs``.

    Null and empty texts have no tokens and get the lowest score; texts of any
    length are read whole, some hundred kilobytes at a time; repeated rows get
    equal scores; other columns are not looked at.
    """
    found = _evidence(docs.select("doc_id", "text"), chain)
    total = F.lit(chain.intercept) + F.col("top") * chain.slopes[0] + F.col("total") * chain.slopes[1]
    return found.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"), "spans")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and spans for every row of ``docs``."""
    scored = with_toxicity(docs, fit_toxicity(docs, labels, folds=folds))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
