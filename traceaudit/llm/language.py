"""Language identification by unigram models that sum over all segmentations.

The pieces are a fixed public vocabulary; for each language every piece gets a
probability, learned by a few rounds of expectation maximisation over the words
of labelled documents. The probability of a word is the sum over all ways to
cut it into pieces, found by a forward pass; a text is the product of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceaudit.llm.common import fold_of, hash31, stored
from traceaudit.llm.shingles import mix

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Labelled documents of each language that a fit reads at most, the first by a hash of their id.
LANGUAGE_ROWS = 1_500
ROUNDS = 3
# Probability of a character that no piece covers; mass added to each piece.
UNKNOWN = 1e-7
SMOOTH = 0.05
UNDETERMINED = "und"
# Letters alone make words, in training and in scoring; numbers of any script, such as halves and squares, are none.
WORD = regex.compile(r"\p{L}+")
MARK = "▁"
CHUNK_CHARS = 400_000
CACHE = 100_000
# Characters of words that are summed together; letters from which a word is summed alone.
BLOCK_CHARS = 40_000
LONG_WORD = 10_000
# A training word is read in parts of so many letters.
TRAINING_LETTERS = 1_000_000
# Odd number whose powers place the letters of a piece in its hash.
_STEP = 0x9E3779B97F4A7C15


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """Distinct pieces of the vocabulary in lower case that consist of letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.removeprefix(MARK).isalpha() or p == MARK)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word ends."""
    return (np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64),
            np.cumsum([len(w) for w in words], dtype=np.int64))


def _sums(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the mixed letters times powers of the step, and the inverse powers."""
    ahead = np.full(len(letters), _STEP, dtype=np.uint64)
    behind = np.full(len(letters) + 1, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
    ahead[:1] = behind[0] = 1
    ahead, behind = np.multiply.accumulate(ahead), np.multiply.accumulate(behind)
    return np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(letters + np.uint64(1)) * ahead, dtype=np.uint64))), behind


def _hashes(sums: np.ndarray, behind: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` letters from each place."""
    return (sums[at + length] - sums[at]) * behind[at]


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Words of like lengths that are summed together; a long word is alone."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 2_000 and (to - at + 1) * lengths[order[to]] <= BLOCK_CHARS:
            to += 1
        yield order[at:to]
        at = to


class Segmenter:
    """Forward and backward sums over the segmentations of words, for all languages at once."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray) -> None:
        """``probabilities`` is (languages, pieces)."""
        self.number = {p: i for i, p in enumerate(pieces)}
        self.table = np.vstack([probabilities.T, np.full((1, probabilities.shape[0]), UNKNOWN)])      # (pieces + 1, languages)
        self.longest = max((len(p) for p in pieces), default=1)
        # Per length: the sorted hashes of all beginnings of pieces, and the piece that each is, or -1.
        self.beginnings = []
        for length in range(1, self.longest + 1):
            known = {p[:length]: -1 for p in pieces if len(p) >= length} | {p: i for p, i in self.number.items() if len(p) == length}
            letters, ends = _letters(list(known))
            hashes = _hashes(*_sums(letters), ends - length, length)
            order = np.argsort(hashes)
            self.beginnings.append((hashes[order], np.array(list(known.values()), dtype=np.int64)[order]))

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of all pieces inside the marked words, by word; single characters always have an arc.

        Places are looked up by 64-bit hashes, all words at a time: those where a
        piece begins with the letters so far go on to the next length.
        """
        letters, ends = _letters([MARK + w for w in words])
        sums = _sums(letters)
        starts = np.concatenate(([0], ends[:-1]))
        owner = np.repeat(np.arange(len(words)), ends - starts)
        alive, found = np.arange(len(letters)), []
        for length, (hashes, numbers) in enumerate(self.beginnings, 1):
            alive = alive[alive + length <= ends[owner[alive]]]
            mine = _hashes(*sums, alive, length)
            spot = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
            known = hashes[spot] == mine
            piece = np.where(known, numbers[spot], -1)
            if length == 1:
                piece[piece < 0] = len(self.table) - 1
            whole = piece >= 0
            found.append((alive[whole], np.full(int(whole.sum()), length), piece[whole]))
            alive = alive[known]
            if not len(alive):
                break
        if not found:                                      # a vocabulary without pieces
            found = [(alive, np.ones(len(alive), dtype=np.int64), np.full(len(alive), len(self.table) - 1))]
        place, length, piece = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        place, length, piece = place[order], length[order], piece[order]
        word = owner[place]
        begin = place - starts[word]
        return word, begin, begin + length, piece

    def forward(self, words: list[str], arcs: tuple | None = None) -> np.ndarray:
        """Natural log of the sums over the segmentations of each beginning: (words, longest word + 2, languages).

        At each position the sums are taken relative to the one before, so that none underflows.
        """
        w, i, j, p = arcs or self.arcs(words)
        size = max(len(x) for x in words) + 2
        logs = np.zeros((len(words), size, self.table.shape[1]))
        order = np.argsort(j, kind="stable")                   # words stay in order
        cuts = np.searchsorted(j[order], np.arange(1, size + 1))
        for end in range(1, size):
            at = order[cuts[end - 1]:cuts[end]]
            if len(at):
                here, start = np.unique(w[at], return_index=True)
                terms = np.exp(logs[w[at], i[at]] - logs[w[at], end - 1]) * self.table[p[at]]
                logs[here, end] = logs[here, end - 1] + np.log(np.add.reduceat(terms, start, axis=0))
        return logs

    def forward_long(self, word: str) -> np.ndarray:
        """Natural log of a long word's sum in each language; only the last sums are held."""
        text = MARK + word
        last = [np.zeros(self.table.shape[1])]                 # of the places before ``end``
        for end in range(1, len(text) + 1):
            terms = np.zeros(self.table.shape[1])
            for k in range(1, len(last) + 1):
                p = self.number.get(text[end - k:end], -1) if k <= end else -1
                if p >= 0 or k == 1:
                    terms += np.exp(last[-k] - last[-1]) * self.table[p if p >= 0 else len(self.table) - 1]
            last = [*last[-max(1, self.longest - 1):], last[-1] + np.log(terms)]
        return last[-1]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability in each language, whatever its length."""
        out = np.zeros((len(words), self.table.shape[1]))
        lengths = np.array([len(x) for x in words])
        for block in _blocks(lengths):
            chosen = [words[b] for b in block]
            if lengths[block[0]] > LONG_WORD:
                out[block[0]] = self.forward_long(chosen[0])
            else:
                out[block] = self.forward(chosen)[np.arange(len(chosen)), lengths[block] + 1]
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece, for the first language of the table, in ``words`` that occur ``counts`` times."""
        arcs = w, i, j, p = self.arcs(words)
        logs = self.forward(words, arcs)[:, :, 0]
        ends = np.array([len(x) + 1 for x in words])
        # beta[k] is the sum over the segmentations of the rest from k, times the forward sum at k, over the word's sum: at most 1.
        beta = np.zeros_like(logs)
        beta[np.arange(len(words)), ends] = 1
        weight = self.table[p, 0] * np.exp(logs[w, i] - logs[w, j])
        order = np.argsort(-i, kind="stable")
        cuts = np.searchsorted(-i[order], -np.arange(logs.shape[1])[::-1], side="right")
        at = 0
        for to in cuts:
            group = order[at:to]
            at = to
            if len(group):
                np.add.at(beta, (w[group], i[group]), weight[group] * beta[w[group], j[group]])
        share = counts[w] * weight * beta[w, j]
        return np.bincount(p, weights=share, minlength=len(self.table))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def training_words(docs: DataFrame, folds: int = 4, held: int = 2, rows: int = LANGUAGE_ROWS) -> DataFrame:
    """lang, word, n of the labelled documents outside the held-out fold, at most ``rows`` documents of each language.

    The choice is made on ids and languages alone, before any text is read.
    """
    known = docs.filter(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    order = hash31(F.lit("language"), F.col("doc_id"))
    # Far more rows than are wanted go no further than their own task; a language stays some thousand rows, whatever its size.
    bound = F.least(F.lit(1.0), F.lit(2.0 * rows + 1_000) / F.count(F.lit(1))) * float(1 << 31)
    bounds = known.groupBy(F.col("lang").alias("_of")).agg(bound.alias("_bound"))
    near = known.select("doc_id", F.col("lang").alias("_lang"), order.alias("_order")).join(F.broadcast(bounds), F.col("_lang") == F.col("_of"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "doc_id"))
    chosen = (near.filter(F.col("_order") < F.col("_bound"))
              .withColumn("_rank", rank).filter(F.col("_rank") <= rows).select(F.col("doc_id").alias("_id"), "_lang").distinct())
    # Bounded by rows times languages, 30 bytes each.
    texts = known.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{TRAINING_LETTERS}}}"), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def fit_languages(words: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities (languages, pieces).

    Starts from probabilities that halve with each letter of a piece. The
    expected counts of a round are added up where the words lie; one number for
    each piece and language comes to the driver.
    """
    words = stored(words.repartition(12, "lang", "word"))
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    start = np.array([0.5 ** len(p) for p in pieces])
    table = np.tile(start / start.sum(), (max(1, len(languages)), 1))
    context = words.sparkSession.sparkContext
    for _ in range(rounds if languages else 0):
        shared = context.broadcast((pieces, languages, table))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, languages, table = shared.value
            models = {l: Segmenter(pieces, table[k:k + 1]) for k, l in enumerate(languages)}
            for batch in batches:
                lang, word, n = (np.array(batch.column(c).to_pylist(), dtype=t) for c, t in (("lang", object), ("word", object), ("n", float)))
                for name in sorted(set(lang)):
                    mine = lang == name
                    some, times = list(word[mine]), n[mine]
                    found = sum(models[name].expected([some[b] for b in block], times[block])
                                for block in _blocks(np.array([len(x) for x in some])))[:-1]
                    at = np.flatnonzero(found > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(found[at])], names=["lang", "piece", "n"])

        sums = words.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        counts = np.full(table.shape, SMOOTH)
        place = {l: k for k, l in enumerate(languages)}
        for r in sums:
            counts[place[r["lang"]], r["piece"]] += r["n"]
        table = counts / counts.sum(axis=1, keepdims=True)
        shared.unpersist()
    return languages, table


def score_languages(docs: DataFrame, pieces: list[str], languages: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score for every row: the most probable language and its share of the probability of all.

    A text that is null or has no letter is ``und`` with the score 0, and so is
    every text if no language was learned. The earlier name wins a tie.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, table))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, table = shared.value
        model, known, logs = Segmenter(pieces, table), {}, np.zeros((0, len(languages)))
        for batch in batches:
            texts, names, scores, at = batch.column("text").to_pylist(), [], [], 0
            while at < len(texts):                              # a bounded amount of text at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHUNK_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                found = [words_of(t) for t in texts[at:end]]
                at = end
                if len(known) > CACHE:
                    known, logs = {}, logs[:0]
                fresh = list(set().union(*found).difference(known))
                if fresh and languages:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    logs = np.vstack([logs, model.log_probabilities(fresh)])
                for ws in found:
                    if not ws or not languages:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = logs[[known[w] for w in ws]].sum(axis=0)
                    best = int(total.argmax())
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    The language of a document is read in training only. Texts are read whole,
    whatever their length; null ids and repeated rows keep their rows.
    """
    pieces = read_pieces(vocabulary)
    languages, table = fit_languages(training_words(docs.select("doc_id", "text", "lang"), folds, held), pieces)
    return score_languages(docs, pieces, languages, table).withColumn("held_out", fold_of(F.col("doc_id"), folds) == held)
