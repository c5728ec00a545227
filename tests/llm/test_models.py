import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

from traceaudit.llm import language, lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LANGUAGES = {"en": "the with and thing have water over small".split(), "de": "der und nicht haus straße schön wasser".split(),
             "fr": "les dans une maison école être petite".split()}


def text_rows(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(3, 30))), lang))
    return rows


def test_language_on_held_out_rows(corpus):
    rows = text_rows()
    odd = [(900, None, "en"), (901, "", None), (902, "123 !? 4", "de"), (None, "der und nicht", None), (903, "und " * 50_000, None),
           (904, "x" * 5_000, None), (905, "日本語 текст", None), (7, rows[7][1], rows[7][2])]
    got = language.identify(corpus(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "de"
    assert all(0 <= r.score <= 1 and r.lang_pred in {*LANGUAGES, "und"} for r in got)


def test_nothing_to_learn(corpus):
    assert [r.lang_pred for r in language.identify(corpus([(1, "some text", None)])).collect()] == ["und"]
    assert language.identify(corpus([])).count() == 0


def ways(text, prob, unknown):
    """All segmentations of a short word, one by one."""
    if not text:
        return [[]]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in prob or n == 1:
            out += [[text[:n], *rest] for rest in ways(text[n:], prob, unknown)]
    return out


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "abc", "b", "bc", "c", language.MARK, language.MARK + "a", language.MARK + "ab"]
    table = np.array([[.1, .2, .05, .1, .15, .1, .1, .1, .1], [.3, .05, .05, .1, .1, .1, .1, .1, .1]])
    model = language.Segmenter(pieces, table)
    for word in ("abc", "cab", "abzab"):
        for k in range(2):
            prob = dict(zip(pieces, table[k]))
            want = sum(math.prod(prob.get(p, language.UNKNOWN) for p in way) for way in ways(language.MARK + word, prob, 0))
            assert np.isclose(model.log_probabilities([word, "b"])[0, k], math.log(want))
    one = language.Segmenter(pieces, table[:1])
    prob, total, want = dict(zip(pieces, table[0])), 0.0, Counter()
    for way in ways(language.MARK + "abc", prob, 0):
        p = math.prod(prob.get(x, language.UNKNOWN) for x in way)
        total += p
        for x in way:
            want[x] += p
    got = one.expected(["abc"], np.array([2.0]))
    assert np.allclose([got[i] for i in range(len(pieces))], [2 * want[p] / total for p in pieces])


def test_long_words_against_exact_arithmetic():
    pieces = ["a", "aa", "aaaaaaaaa", "b", "ba", language.MARK, language.MARK + "a"]
    table = np.array([[1e-6, 2e-7, 1e-9, 3e-6, 1e-7, 1e-3, 1e-5], [2e-6, 1e-7, 1e-9, 1e-6, 2e-7, 1e-3, 1e-5]])
    words = ["a", "ab" * 150, "a" * 450, "z" * 500, "b" * 100 + "a" * 300]
    model = language.Segmenter(pieces, table)
    got = model.log_probabilities(words)
    assert np.allclose(got, [model.forward_long(w) for w in words], rtol=1e-12)
    for k in range(2):
        prob = {p: Fraction(x) for p, x in zip(pieces, table[k].tolist(), strict=True)}
        for word, logs in zip(words, got, strict=True):
            text, sums = language.MARK + word, [Fraction(1)]
            for end in range(1, len(text) + 1):
                sums.append(sum(sums[i] * prob.get(text[i:end], Fraction(language.UNKNOWN) if end - i == 1 else 0) for i in range(max(0, end - 9), end)))
            want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert math.isclose(logs[k], want, rel_tol=1e-9)
    # Every letter of a long word is in one piece.
    found = language.Segmenter(pieces, table[:1]).expected(["a" * 450], np.array([2.0]))
    assert math.isclose(sum(n * len(p) for n, p in zip(found, pieces, strict=False)), 2 * 451, rel_tol=1e-9)


def test_all_letter_pieces_are_used():
    assert max(map(len, language.read_pieces())) > 9 and language.LANGUAGE_ROWS == 1_500


def test_base_scores_and_counts(corpus):
    rows = [(i, t) for i, t, _ in text_rows(200)] + [(500, None), (501, ""), (501, ""), (None, "The THE the"), (502, "neverseen " * 3), (503, "und " * 30_000)]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [" "] for _, t in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), h, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + .1) / (total + .1 * (kinds + 1))) for w in ws), 6))
                  for (i, _), ws, h in zip(rows, tokens, held, strict=True))
    for table in (1 << 18, 8):                                     # with and without words that are looked up by a join
        old, lm.LOOKUP = lm.LOOKUP, table
        dishes, lm.DISHES = lm.DISHES, min(lm.DISHES, table)
        try:
            got = lm.score_texts(corpus(rows)).collect()
        finally:
            lm.LOOKUP, lm.DISHES = old, dishes
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == total and r.score < 0 and math.isfinite(r.score) for r in got)
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_nothing_to_train_on(corpus):
    got = lm.score_texts(corpus([(1, "a")]).filter("doc_id is null or doc_id = 1").filter("false")).collect()
    assert got == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lm.score_texts(corpus([(held, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score) and row.base_score == 0


def test_seating():
    key = np.arange(20_000, dtype=np.uint64)
    for a, d, c in ((2.0, 0.5, 10), (0.7, 0.3, 60), (5.0, 0.0, 400)):
        got = lm.seat(np.full(20_000, c), np.full(20_000, a), d, key, 1).mean()
        expect, dist = 0.0, {1: 1.0}
        for i in range(1, c):
            nxt = Counter()
            for t, p in dist.items():
                up = a / (a + i - d * t)
                nxt[t + 1] += p * up
                nxt[t] += p * (1 - up)
            dist = nxt
        expect = sum(t * p for t, p in dist.items())
        assert abs(got - expect) < 0.03 * expect
    assert lm.seat(np.array([0, 1, 10**9]), np.array([1.0, 1.0, 1e-9]), 0.5, key[:3], 1).tolist()[:2] == [0, 1]


def test_contexts_are_distributions():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, size=(6, 50)) * rng.integers(1, 40, size=(6, 50))
    logs = lm.sample_contexts(counts, np.array([0, 1, 1, 0])).logs
    assert logs.shape == (6, 50) and np.allclose((10 ** logs).sum(axis=1), 1)


def test_only_letters_make_words(spark, corpus):
    table = np.full((2, 3), 1 / 3)
    docs = corpus([(1, "½ ² ① ³ 42 _ ٣"), (2, "a½"), (3, None), (4, ""), (5, "Ⅷ"), (6, "ß")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.score_languages(docs, ["▁", "a", "ß"], ["x", "y"], table).collect()}
    assert [got[i] for i in (1, 3, 4, 5)] == [("und", 0.0)] * 4
    assert got[2] == got[6] == ("x", 0.5)


def test_arcs_against_a_plain_search():
    rng = random.Random(8)
    letters = "abcé中𝒳"
    pieces = sorted({"▁", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)), "▁ab", "▁c", "abcabcabc"})
    model = language.Segmenter(pieces, np.ones((1, len(pieces))) / len(pieces))
    words = ["".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    number, want = {p: i for i, p in enumerate(pieces)}, set()
    for w, word in enumerate(words):
        text = "▁" + word
        for i in range(len(text)):
            want |= {(w, i, j, number[text[i:j]]) for j in range(i + 1, len(text) + 1) if text[i:j] in number}
            if text[i] not in number:
                want.add((w, i, i + 1, len(pieces)))
    arcs = model.arcs(words)
    assert len(arcs[0]) == len(want) and set(zip(*(a.tolist() for a in arcs), strict=True)) == want
    assert (np.diff(arcs[0]) >= 0).all()


def test_long_training_words_are_learned_whole(corpus):
    docs = corpus([(i, "ab" * 3_000 + " ba", "x") for i in range(1, 9)] + [(i, "cd " * 50, "y") for i in range(20, 30)])
    words = {r["word"]: r["n"] for r in language.training_words(docs).collect()}
    assert max(map(len, words)) == 6_000
    names, table = language.fit_languages(language.training_words(docs), ["▁", "a", "ab", "b", "c", "cd", "d"])
    assert names == ["x", "y"] and np.allclose(table.sum(axis=1), 1) and table[0, 2] > 10 * table[0, 5]


def pair_rows(n=400, kinds=300):
    """Texts of random pairs; a pair's first word settles the second, and all first words end alike."""
    rng = random.Random(6)
    return [(i, " ".join(f"c{k}ing f{k}er" for k in (rng.randrange(kinds) for _ in range(rng.randrange(10, 40))))) for i in range(n)]


def test_every_word_is_a_context(corpus):
    got = [r for r in lm.score_texts(corpus(pair_rows())).collect() if r.held_out]
    # Every other word costs log10(300) = 2.5, the words between them little, however many contexts there are.
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -1.5


def test_scores_do_not_depend_on_what_is_broadcast(corpus, monkeypatch):
    docs, want = corpus([*pair_rows(60, 40), *((1_000 + i, t) for i, t, _ in text_rows(60)), (None, "c1ing f2er new"), (7_000, None)]), None
    for lookup, dishes, rounds, part in ((1 << 18, 1 << 20, 4, 1 << 16), (12, 1 << 20, 1, 1 << 16), (1 << 18, 5, 3, 1 << 16), (0, 0, 2, 1 << 16)):
        for name, value in (("LOOKUP", lookup), ("DISHES", dishes), ("ROUNDS", rounds), ("PART", part)):
            monkeypatch.setattr(lm, name, value)
        got = sorted((str(r.doc_id), r.n_known, round(r.score, 7)) for r in lm.score_texts(docs).collect())
        want = want or got
        assert got == want


def test_all_pairs_are_counted_and_probabilities_add_up(corpus, monkeypatch):
    from pyspark.sql import functions as F
    rows = [*pair_rows(60, 40), *((1_000 + i, t) for i, t, _ in text_rows(60))]
    for part in (1 << 16, 3):                                      # whole restaurants, and restaurants in parts
        monkeypatch.setattr(lm, "PART", part)
        pairs = lm._pair_counts(corpus(rows), F.col("doc_id") % 10 == 0)
        counts, held = Counter(), set()
        for i, text in rows:
            tokens = [" ", *text.split(), " "]
            for pair in zip(tokens[:-1], tokens[1:], strict=True):
                counts[pair] += i % 10 != 0
                held |= {pair} if i % 10 == 0 else set()
        found = [(r.u, r.w, r.c, r.asked) for r in pairs.collect()]
        assert len({(u, w) for u, w, _, _ in found}) == len(found)
        assert sorted((c, a) for _, _, c, a in found) == sorted((c, p in held) for p, c in counts.items() if c)
        tables, words, d, unknown = lm._seated(pairs, lm._words_of(pairs))
        words = {r.h: r for r in words.collect()}
        assert math.isclose(sum(r.r for r in words.values()) + unknown, 1, rel_tol=1e-12)
        taken = Counter()
        for r in tables.collect():
            assert r.c > 1 and 1 <= r.t <= r.c
            taken[r.u] += r.c - d * r.t
        for u, _, c, _ in found:
            taken[u] += (1 - d) * (c == 1)
        # What the pairs take of a context and what it passes to the root make the whole.
        assert all(math.isclose(taken[u] + r.share, r.c + lm.STRENGTH, rel_tol=1e-12) for u, r in words.items())
