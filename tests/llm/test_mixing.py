import re
from collections import defaultdict

from pyspark.sql import functions as F

from traceaudit.llm import mixing


def fill(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and share and rest * weight[s] / share > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else (rest * weight[s] / share if share else 0) for s in names}
        full |= over


def rows_of(n):
    out = [(i, " ".join(["w"] * (i % 7)), None, ["b", "a", None, "é", "tiny"][i % 5]) for i in range(n)]
    out += [(i, "one two three four five six seven eight nine ten", None, "a") for i in range(n, 4 * n)]
    return out + [(5000, None, None, "nothing"), (5001, "", None, "nothing"), (7, "again", None, "b"), (7, "again", None, "b"), (None, "no id", None, "b")]


def plan_of(docs, **kw):
    return mixing.mix(docs, mixing.word_count(F.col("text")), range_rows=kw.pop("range_rows", 20), **kw)


def test_targets_and_exact_cuts(corpus):
    rows = rows_of(120)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = fill(sizes)
    got = plan_of(corpus(rows)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)


def test_same_rows_same_mix(corpus):
    rows = rows_of(60)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(plan_of(corpus(rows))) == key(plan_of(corpus(rows[::-1]).repartition(5), range_rows=7))


def test_documents_follow_the_plan(corpus):
    rows = rows_of(60)
    docs = corpus(rows)
    plan = plan_of(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    out = mixing.mixed_documents(docs, mixing.word_count(F.col("text")), range_rows=20)
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for r in plan:
        assert abs(got[r.source] - r.taken) <= r.most
    assert out.filter("source = 'nothing'").count() == 2


def test_empty_table(corpus):
    assert plan_of(corpus([])).count() == 0
    assert mixing.mixed_documents(corpus([]), mixing.word_count(F.col("text"))).count() == 0
