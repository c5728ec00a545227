import importlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from traceaudit.llm import common, jaccard
from traceaudit.llm.components import components
from traceaudit.llm.shingles import shingle_sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, group = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return Counter((r[0], len(s), least.get(g) if s else r[0]) for r, g, s in zip(rows, group, sets, strict=True))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus_rows():
    rng = random.Random(5)
    rows, at = [], 100
    for size in (6, 12, 40, 200):
        for _ in range(5):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for edits in (0, 0, 1, 2, size // 20, size // 12):
                rows.append((at, edited(rng, base, edits)))
                at += 1
    chain = [f"c{i}" for i in range(60)]                          # each link holds, the ends are far apart
    for k in range(12):
        rows.append((at + k, " ".join(chain[k * 4:k * 4 + 40])))
    common = " ".join(f"line{i}" for i in range(25))
    rows += [(1000 + i, common + " " + " ".join(f"u{i}_{k}" for k in range(i % 12))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "One  Two"), (None, "alone here now ok yes"),
             (8, "É é"), (9, "é é"), (100, "another text of the same id here"), (10, "long " * 50_000), (11, "long " * 60_000 + "end")]
    return rows


def test_against_brute_force(corpus):
    rows = corpus_rows()
    got = jaccard.jaccard_components(corpus(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all((r.n_links > 0) <= (r.n_shingles > 0) for r in got)


def test_hot_grams_are_dealt_out_without_losing_links(corpus, monkeypatch):
    rows = corpus_rows()
    monkeypatch.setattr(jaccard.prefix_grams, "__defaults__", (3,))
    monkeypatch.setattr(jaccard.verify, "__defaults__", (0,))        # and by the shuffle of texts
    monkeypatch.setattr(jaccard, "CROWD", 3)
    got = jaccard.jaccard_components(corpus(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def brute_links(rows):
    sets = [grams(r[1]) for r in rows]
    count = [sum(100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets) if j != i and a and b) for i, a in enumerate(sets)]
    return Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, count, strict=True))


@pytest.mark.parametrize("block_classes, block_grams, step", [(256, 1 << 20, 1 << 13), (4, 100, 7)])
def test_all_links_are_counted(corpus, monkeypatch, block_classes, block_grams, step):
    rng = random.Random(9)
    base = [f"n{rng.randrange(10**6)}" for _ in range(100)]
    rows = corpus_rows() + [(2000 + i, edited(rng, base, i % 3)) for i in range(30)]      # nearly all of them link with each other
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block_classes)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block_grams)
    monkeypatch.setattr(jaccard, "STEP_GRAMS", step)
    got = jaccard.jaccard_components(corpus(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == brute_links(rows)


def test_one_of_each(corpus):
    rows = [(2, "a b c d e f"), (1, "A b c d e f"), (3, "x y"), (4, None), (4, None), (5, ""), (2, "a b c d e f"), (3, "other words than that here")]
    docs = corpus(rows)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, [
        (1, "A b c d e f"), (3, "x y"), (4, None), (5, ""), (3, "other words than that here")]))


def test_empty_table(corpus):
    assert jaccard.jaccard_components(corpus([])).count() == 0
    assert jaccard.one_of_each(corpus([])).count() == 0


@pytest.mark.parametrize("texts", [["a b c d e f", None, "", "  a", "É b", "a\tb\nc d e\x0bf g"], [""], [None], ["z" * 3_000_000 + " b c d e f", "b"]])
def test_shingle_counts(texts):
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(grams(t)) for t in texts]
    assert all((np.diff(s.astype(object)) > 0).all() for s in shingle_sets(pa.array(texts, pa.string())))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def folders(spark):
    root = spark._jvm.org.apache.hadoop.fs.Path(common.durable_dir(spark))
    return {f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}


def test_stars_take_no_round(spark, monkeypatch):
    written, module = [], importlib.import_module("traceaudit.llm.components")
    monkeypatch.setattr(module, "stored", lambda df: written.append(1) or common.stored(df))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 60)], "a long, b long")
    assert {r.node: r.root for r in components(stars).collect()} == {i: i % 3 for i in range(3, 60)} and len(written) == 1
    joined = stars.unionByName(spark.createDataFrame([(58, 59), (2, 3)], "a long, b long"))
    assert {r.node: r.root for r in components(joined).collect()} == {i: 0 for i in range(1, 60)}


def test_only_what_the_result_reads_stays_stored(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 3)
    docs, before, listed = corpus(corpus_rows()), folders(spark), len(common._STORED)
    assert jaccard.jaccard_components(docs).count() == len(corpus_rows())
    left = {f for f in folders(spark) - before if f.startswith("llm-")}
    assert left == {p.rsplit("/", 1)[-1] for p in common._STORED[listed:]} and len(left) == 1


def test_earlier_grams_only_save_work(corpus, monkeypatch):
    rows = corpus_rows()
    monkeypatch.setattr(jaccard, "CROWD", 1000)
    for known in (1, 3):
        monkeypatch.setattr(jaccard, "EARLIER", known)
        got = jaccard.jaccard_components(corpus(rows)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_counts_of_ranges_beyond_two_bytes():
    rows = [np.arange(256) * 300, np.arange(256)]
    packed = [jaccard._packed(r) for r in rows]
    assert [len(p) for p in packed] == [1024, 512]
    for packs, want in ((packed, rows), (packed[:1], rows[:1]), (packed[1:], rows[1:])):
        assert (jaccard._unpacked(pa.array(packs)) == np.array(want)).all()
