"""Elements of large JSON arrays, cut anywhere."""

import json
import random

import pytest

from traceaudit.sources import jsonarray as J
from traceaudit.sources.files import Reader


def in_pieces(path, key, split):
    """The reader's steps without Spark."""
    import pandas as pd
    size = path.stat().st_size
    uri = f"file:{path}"
    with Reader(uri) as reader:
        steps = [J._summary(reader, uri, a, min(size, a + split), size, key) for a in range(0, size, split)]
        if not steps:
            return []
        known = J._joined(pd.DataFrame(steps))
        return [json.loads(raw) for r in known.itertuples(index=False) for _, raw in J._elements(reader, *list(r)[1:])]


def value(rng, deep=0):
    kind = rng.randrange(9 if deep < 3 else 6)
    if kind < 2:
        return "".join(rng.choice(['a', '"', "\\", "[", "]", "{", "}", ",", ":", "é", "\n", "runs", '"runs":[']) for _ in range(rng.randrange(12)))
    if kind < 6:
        return rng.choice([1, -2.5, None, True, "", "\\\\", '\\"'])
    if kind < 8:
        return {f"k{i}": value(rng, deep + 1) for i in range(rng.randrange(4))}
    return [value(rng, deep + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("seed", range(12))
def test_cut_anywhere(tmp_path, seed):
    rng = random.Random(seed)
    for n in range(25):
        rows = [value(rng) for _ in range(rng.randrange(12))]
        bare = rng.random() < 0.3
        whole = rows if bare else {"before": [1, [2, {"runs": [3]}], "x"], "note": 'say "runs": [1]', "runs": rows, "after": [[4], 5]}
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5), encoding="utf-8")
        for split in (1, 2, 7, 50, 1 << 20):
            assert in_pieces(path, "runs", split) == rows, (n, split)


def test_files_without_the_array(tmp_path):
    for n, text in enumerate(["", "{}", '{"other": [1]}', "[]", '{"runs": {}}', "[", '{"x": {"runs": [1]}}', "no json"]):
        path = tmp_path / f"{n}.json"
        path.write_text(text)
        assert in_pieces(path, "runs", 3) == [], text


def test_read_by_many_tasks(spark, tmp_path):
    rows = [{"i": i, "text": "[" * (i % 5) + '"' * (i % 3)} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps({"runs": rows}))
    (tmp_path / "b.json").write_text(json.dumps(rows[:7]))
    (tmp_path / "c.json").write_text("{}")
    found = J.numbered(J.read_json_array(spark, str(tmp_path), split_bytes=256), "pos").collect()
    got = {}
    for r in found:
        got.setdefault(r.log_path.rsplit("/", 1)[-1], []).append((r.pos, json.loads(r.text)))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {"a.json": list(enumerate(rows)), "b.json": list(enumerate(rows[:7]))}
    assert J.read_json_array(spark, str(tmp_path), split_bytes=256).rdd.getNumPartitions() >= 1


@pytest.mark.parametrize("seed", range(3))
def test_a_range_is_looked_at_in_pieces(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    sizes = []
    read = Reader.read
    monkeypatch.setattr(Reader, "read", lambda self, start, stop: (sizes.append(stop - start), read(self, start, stop))[1])
    for n, piece in enumerate((1, 3, 10, 64)):
        monkeypatch.setattr(J, "PIECE", piece)
        monkeypatch.setattr(J, "TAIL", 64)
        rows = [value(rng) for _ in range(30)]
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps({"note": 'say "runs": [1]', "runs": rows, "after": [[4], 5]}), encoding="utf-8")
        for split in (7, 50, 1 << 20):
            assert in_pieces(path, "runs", split) == rows, (n, split)
    assert max(sizes) <= 64


def test_files_are_written_piece_by_piece(spark, tmp_path):
    from pyspark.sql import functions as F
    from traceaudit.plans.span_queries import write_pieces
    items = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string"), F.lit("/x.json")).alias("name"), F.lit(True).alias("item"),
                                     F.col("id").alias("pos"), F.col("id").cast("string").alias("value"))
    ends = items.select("name").distinct().select("name", F.lit(False).alias("item"), F.inline(F.expr("array(struct(-1L as pos, '[' as value), struct(9999L as pos, ']' as value))")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        write_pieces(items.unionByName(ends), str(tmp_path), ",")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        assert json.loads((tmp_path / f"f{k}" / "x.json").read_text()) == list(range(k, 3000, 3))


def test_many_small_files_share_tasks(spark, tmp_path):
    for n in range(80):
        (tmp_path / f"{n}.json").write_text(json.dumps([n, n + 1]))
    assert J.read_json_array(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_many_files_cost_no_table_each(spark, tmp_path, monkeypatch):
    for n in range(40):
        (tmp_path / f"f{n:02}.json").write_text('{"note": "runs\\": [", "runs": [%s]}' % ", ".join(f'{{"n": {n}, "k": {k}}}' for k in range(n)))
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", lambda *_: pytest.fail("a pandas table for one file"))
    got = [(json.loads(r.text)["n"], json.loads(r.text)["k"]) for r in J.read_json_array(spark, str(tmp_path), split_bytes=64).orderBy("log_path", "start").collect()]
    assert got == [(n, k) for n in range(40) for k in range(n)]


def test_elements_are_not_taken_to_be_as_small_as_the_list_of_files(spark, tmp_path):
    rows = [{"i": i, "text": "x" * 50} for i in range(2000)]
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    elements = J.read_json_array(spark, str(tmp_path))
    assert elements._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 2 * len(json.dumps(rows))
    placed = J.numbered(elements, "pos")
    assert "Broadcast" not in placed._jdf.queryExecution().executedPlan().toString()   # of a side whose size nobody knows yet
    assert sorted((r.pos, json.loads(r.text)["i"]) for r in placed.collect()) == sorted(2 * [(i, i) for i in range(2000)])
