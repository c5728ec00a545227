"""The language model's pairs travel in blocks, and dishes of many tables are seated in few steps."""

import random

import numpy as np
from pyspark.sql import functions as F

from traceaudit.llm import lm


def test_finder_against_a_dict():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1_000):
        among = np.unique(np.append(rng.integers(0, 2**64, n, dtype=np.uint64), np.array([0, 2**64 - 1], dtype=np.uint64)[:n]))
        place = {x: i for i, x in enumerate(among.tolist())}
        asked = np.concatenate((among, rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 1, 2**64 - 1], dtype=np.uint64)))
        assert lm.Finder(among).find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]


def test_many_tables_need_few_draws(monkeypatch):
    made, chance = [], lm._chance
    monkeypatch.setattr(lm, "_chance", lambda key, turn: made.append(1) or chance(key, turn))
    customers, opening = np.array([2_000_000, 3, 400]), np.array([2_000.0, 1.0, 5.0])
    got = lm.seat(customers, opening, 0.5, np.array([7, 8, 9], dtype=np.uint64), 1)
    assert len(made) < 500 and (1 <= got).all() and (got <= customers).all()
    assert 12_000 < got[0] < 18_000                                 # without a discount 2,000 * log(1 + 1,000) = 13,800
    few = lm.seat(customers, opening, 0.5, np.array([7, 8, 9], dtype=np.uint64), 1)
    monkeypatch.setattr(lm, "FEW", 0)
    assert np.abs(lm.seat(customers[1:], opening[1:], 0.5, np.array([8, 9], dtype=np.uint64), 1) - few[1:]).max() <= 1


def test_pairs_are_asked_for_in_blocks(corpus):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(3_000)}" for _ in range(100))) for i in range(200)]
    shared = corpus(rows).sparkSession.sparkContext.broadcast(lm.Lookup(*(np.zeros(0, dtype=k) for k in (np.uint64, float, float, float))))
    top = corpus(rows).filter("false").select(F.lit(1).cast("long").alias("pair"), F.lit(1.0).alias("one"), F.lit(1.0).alias("none")).toArrow()
    parts = lm._read_texts(corpus(rows), F.col("doc_id") % 10 == 0, shared, top, 0.5, 16).collect()
    texts, blocks = ([r for r in parts if r.kind == k] for k in (lm.TEXTS, lm.PAIRS))
    assert sorted(i for r in texts for i in r.ids) == list(range(200))
    # One row for a bucket of a chunk holds all its pairs.
    assert len(blocks) <= 16 * len(texts) and sum(len(r.numbers) for r in blocks) == 8 * 200 * 101
    seen = {i: 0 for i in range(200)}
    ids = {r.chunk: r.ids for r in texts}
    for r in blocks:
        for place in np.cumsum(np.frombuffer(r.places, dtype=np.int32)).tolist():
            i = ids[r.chunk][place >> 1]
            assert (place & 1) == (i % 10 == 0)
            seen[i] += 1
    assert set(seen.values()) == {101}
