import math
import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traceaudit.llm import quality, toxicity

SYLLABLES = "ba re mi lo tu na ke so vi da ro pe".split()


def sentence(rng, n=9):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark, corpus):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good, toxic = rng.random() > 0.25, rng.random() < 0.2
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 8)))
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "flegelhaft", "miesling"]) + rng.choice(["", "en"]))
            text = " ".join(words)
        if not good:
            text = text.upper().replace(".", "!!") if i % 2 else " ".join(w for w in text.split() for _ in range(5))
        rows.append((i, text))
        labels.append((i, int(good), int(toxic), "clash"))
    labels += [(None, 1, 0, "x"), (3, None, None, "x")]
    odd = [(9001, None), (9002, ""), (9003, "Da. " * 40_000), (None, "Mi lo."), (5, rows[5][1])]
    return corpus(rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string"), {r[0]: r for r in labels[:600]}


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_and_odd_rows(labelled, kind):
    docs, labels, truth = labelled
    out = (quality.quality_scores if kind == "quality" else toxicity.toxicity_scores)(docs, labels).collect()
    assert len(out) == 605
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    at = 1 if kind == "quality" else 2
    right = sum(r.predicted == truth[r.doc_id][at] for r in held) / len(held)
    assert right > 0.95
    if kind == "toxic":
        texts = {r.doc_id: r.text for r in docs.filter("doc_id < 600").collect()}
        spans = [texts[r.doc_id][a:b] for r in out if r.doc_id in truth for a, b in
                 [map(int, s.split(":")) for s in r.spans.split(",") if s]]
        assert len(spans) > 200 and sum(s.lower().startswith(("grob", "fleg", "mies")) for s in spans) > 0.95 * len(spans)
        assert {r.predicted for r in out if r.doc_id in (9001, 9002, 9003)} == {0}


def test_no_labels_and_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = corpus([(1, "a b"), (2, None)])
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity_scores(docs, none).collect()} == {0}
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 3)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.quality_scores(docs, one).collect()} == {1}
    assert quality.quality_scores(corpus([]), none).count() == 0
    assert toxicity.toxicity_scores(corpus([]), none).count() == 0


def test_rules_are_paths():
    text = """Forest
  Tree 0 (weight 1.0):
    If (feature 0 <= 1.5)
     If (feature 2 > 0.25)
      Predict: 1.0
     Else (feature 2 <= 0.25)
      Predict: 0.0
    Else (feature 0 > 1.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 1 <= 4.0)
     Predict: 0.0
    Else (feature 1 > 4.0)
     Predict: 1.0
"""
    a, b, c = quality.STATISTICS[:3]
    assert [set(r.terms) for r in quality.read_rules(text)] == [
        {(a, False, 1.5)}, {(a, False, 1.5), (c, True, 0.25)}, {(a, False, 1.5), (c, False, 0.25)}, {(a, True, 1.5)}, {(b, False, 4.0)}, {(b, True, 4.0)}]


def test_statistics_by_hand(corpus):
    row = quality.statistics(corpus([(1, "ABC abc abc 12!\nabc\nabc")])).select([F.col(f"_s_{n}") for n in quality.STATISTICS]).first()
    got = dict(zip(quality.STATISTICS, row))
    assert got["words"] == pytest.approx(math.log1p(6)) and got["upper"] == pytest.approx(3 / 23) and got["digit"] == pytest.approx(2 / 23)
    assert got["repeat_words"] == pytest.approx(2 / 6) and got["distinct_words"] == pytest.approx(3 / 6) and got["repeat_lines"] == pytest.approx(1 / 3)


def test_marginals_sum_over_all_labellings():
    rng = np.random.default_rng(0)
    emissions, moves = rng.normal(size=(5, 1)), rng.normal(size=4)
    weight = {}
    for tags in product((0, 1), repeat=5):
        s = sum(emissions[t, 0] for t in range(5) if tags[t]) + sum(moves[2 * a + b] for a, b in zip(tags, tags[1:]))
        weight[tags] = math.exp(s)
    want = [sum(w for t, w in weight.items() if t[k]) / sum(weight.values()) for k in range(5)]
    assert np.allclose(toxicity.marginals(emissions, moves)[:, 0], want)
    pairs = np.zeros(4)
    for tags, w in weight.items():
        for a, b in zip(tags, tags[1:]):
            pairs[2 * a + b] += w / sum(weight.values())
    assert np.allclose(toxicity._expected(emissions, moves)[1], pairs)


CHAIN = toxicity.Chain({"w=idiot": 12.0, "p=idio": 1.0, "s=iot": 0.5, "r=größen": 3.0, "w=蠢": 11.0, "q=naïve": 2.0}, bias=-8.0)


def test_hashed_features_equal_the_named_ones():
    words = ["idiot", "IDIOT", "idio", "riot", "größenwahn", "蠢", "x", "naïveté", "_", "42", "idiots"]
    text = " ".join(words)
    data, ends = np.frombuffer(text.lower().encode(), dtype=np.uint8), np.array([len(text.lower().encode())])
    start, stop = toxicity.word_edges(data, ends, toxicity.BETWEEN)
    got = toxicity.emissions(data, toxicity.Bytes(data), start, stop, CHAIN, CHAIN.tables())
    assert np.allclose(got, [CHAIN.emission(w.lower()) for w in words])


@pytest.mark.parametrize("text, spans", [
    ("you idiot now", [(4, 9)]), ("you “idiot” now", [(5, 10)]), ("you—idiot—now", [(4, 9)]), ("IDIOT", [(0, 5)]), ("好人。蠢。好人", [(3, 4)]), ("蠢！好", [(0, 1)]),
    ("an idiotic word", []), ("¿idiot?", [(1, 6)]), ("«idiot»", [(1, 6)]), ("", []), (None, []), ("😀idiot😀", [(1, 6)]), ("é idiot", [(2, 7)])])
def test_typographic_marks_end_tokens(text, spans):
    (top, _, found), = toxicity.score_texts(pa.array([text], pa.string()), CHAIN)
    assert found == spans and (top > 0) == bool(spans)


def test_tokens_in_bulk_are_those_of_the_pattern():
    texts = ["a—b “c” d。e！f ½g 中文、字 ñandú’s", "naïve​x ýz ©®™ 𝒳𝒴 😀ok", "١٢ हिन्दी — test"]
    for text in texts:
        data = toxicity.plain_breaks(np.frombuffer(text.encode(), dtype=np.uint8))
        raw = text.encode()
        start, stop = toxicity.word_edges(data, np.array([len(data)]), toxicity.BETWEEN)
        assert [raw[a:b + 1].decode() for a, b in zip(start, stop, strict=True)] == toxicity.TOKEN.findall(text)


def test_sentences_together_equal_sentences_alone():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 7, 3, 40, 1, 2])
    values, moves = rng.normal(size=lengths.sum()) * 5, rng.normal(size=4)
    parts = [toxicity.marginals(part[:, None], moves)[:, 0] for part in np.split(values, np.cumsum(lengths)[:-1])]
    assert np.allclose(toxicity.sentence_marginals(values, lengths, moves), np.concatenate(parts))
