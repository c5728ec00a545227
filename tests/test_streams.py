"""Streams give the batch result, drop late votes and survive a restart."""

import datetime as dt
import shutil

from pyspark.sql import functions as F

from tests.test_spans import chat, write
from traceaudit.operators import judging
from traceaudit.sources import spans
from traceaudit.sources.spans import ingest_spans
from traceaudit.streaming import streams

SCHEMA = "trace_id string, judge_model string, stage string, run_idx bigint, judgment string, ts timestamp"
T0 = dt.datetime(2024, 1, 1, 10)


def votes(trace, minute, labels, stage="j2"):
    return [(trace, "J", stage, i, v, T0 + dt.timedelta(minutes=minute, seconds=i)) for i, v in enumerate(labels)]


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_updates_end_at_the_batch_result(spark, tmp_path):
    first = votes("a", 0, ["policy_absent"] * 2, "j1") + votes("a", 1, ["hard_violation"])
    second = votes("b", 2, ["policy_absent"] * 3, "j1") + votes("b", 3, ["soft_violation", "hard_violation", "no_violation"])
    put(spark, tmp_path / "in", "x", first)
    put(spark, tmp_path / "in", "y", second)
    out = streams.consensus_stream(source(spark, tmp_path / "in"))
    streams.upsert_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    third = [("a", "J", "j2", 1, "no_violation", T0 + dt.timedelta(minutes=4))]
    put(spark, tmp_path / "in", "z", third)
    streams.upsert_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()    # a restart
    got = streams.newest(spark.read.parquet(str(tmp_path / "out")), ["window_start", "trace_id", "judge_model"])
    batch = judging.consensus(spark.createDataFrame(first + second + third, SCHEMA))
    columns = ["trace_id", "judge_model", "j1_consensus", "j2_consensus", "accepted"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r) for r in batch.select(columns).collect())


def test_append_closes_windows_and_drops_late_votes(spark, tmp_path):
    put(spark, tmp_path / "in", "x", votes("a", 0, ["policy_absent"] * 3, "j1") + votes("a", 1, ["hard_violation"] * 3))
    out = streams.consensus_stream(source(spark, tmp_path / "in"), window="1 hour")
    def run():
        q = streams.append_stream(out, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        return sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    run()
    put(spark, tmp_path / "in", "y", votes("b", 600, ["policy_absent"], "j1"))
    run()
    put(spark, tmp_path / "in", "z", votes("a", 2, ["no_violation"] * 9))
    assert run() >= 1
    rows = spark.read.schema("trace_id string, accepted boolean").parquet(str(tmp_path / "out")).collect()
    assert [(r.trace_id, r.accepted) for r in rows] == [("a", True)]


def test_ledger_keeps_one_row_per_key(spark, tmp_path):
    put(spark, tmp_path / "in", "x", votes("a", 0, ["x", "y"]))
    put(spark, tmp_path / "in", "y", votes("a", 1, ["x", "y", "z"]))
    rows = streams.ledger_stream(source(spark, tmp_path / "in"))
    streams.append_stream(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.run_idx for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_log_stream_takes_only_new_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "a.log", chat("A"), "noise", chat("B"))
    def run():
        streams.ingest_spans_stream(spark, str(logs), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    write(logs, "b.log", chat("C"))
    run()
    columns = ["log_file", "span_idx", "name", "span_json"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns)
    want = ingest_spans(spark, str(logs)).select(columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    assert got.filter(F.col("log_file") == "b.log").count() == 1


def test_batches_of_small_logs_are_numbered_without_a_shuffle(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(5):
        write(logs, f"{n}.log", chat(f"A{n}"), "noise", *[chat(f"B{i}") for i in range(n)])
    files = [(f"file:{p}", f"name:{p}", p.stat().st_size) for p in sorted(logs.iterdir())]
    small = spans.spans_of_files(spark, files)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    columns = ["log_file", "span_idx", "name", "attributes", "span_json"]
    want = sorted(repr(r) for r in ingest_spans(spark, str(logs)).select(columns).collect())
    assert sorted(repr(r) for r in small.select(columns).collect()) == want
    assert {r.log_path for r in small.collect()} == {name for _, name, _ in files[1:]}          # the only piece of the first is broken
    # Files of several ranges are numbered across them.
    assert sorted(repr(r) for r in spans.spans_of_files(spark, files, 16).select(columns).collect()) == want


def test_a_batch_of_small_logs_is_one_job(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for n in range(6):
        write(logs, f"{n}.log", chat(f"A{n}"), "noise", *[chat(f"B{i}") for i in range(n)])
    setting = "spark.sql.streaming.checkpointFileManagerClass"
    before = spark.conf.get(setting, None)
    query = streams.ingest_spans_stream(spark, str(logs), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_batch=2)
    query.awaitTermination()
    assert spark.conf.get(setting, None) == before
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3                                   # of two logs each
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) == 3
    columns = ["log_path", "log_file", "span_idx", "name", "attributes", "span_json"]
    got, want = spark.read.parquet(str(tmp_path / "out")), ingest_spans(spark, str(logs))
    assert got.columns == [*columns, "batch"]
    shown = lambda df: sorted(repr(r)[repr(r).index("log_file"):] for r in df.select(columns).collect())
    assert shown(got) == shown(want)


def test_large_logs_of_a_batch_are_read_by_ranges(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "a.log", chat("A"), "noise", chat("B"))
    write(logs, "b.log", *[chat(f"L{i}") for i in range(40)], "noise {", chat("M"))
    write(logs, "c.log", *[chat(f"K{i}") for i in range(30)])
    write(logs, "d.log", "nothing")
    ranged, whole = [], streams.spans_of_files
    monkeypatch.setattr(streams, "SMALL_BYTES", 1_000)
    monkeypatch.setattr(streams, "spans_of_files", lambda session, files: (ranged.extend(f[0].rsplit("/", 1)[-1] for f in files), whole(session, files, 512))[1])
    for _ in range(2):                                                                          # the second time, the same batch again
        streams.ingest_spans_stream(spark, str(logs), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        shutil.rmtree(tmp_path / "cp")
    assert sorted(ranged) == ["b.log", "b.log", "c.log", "c.log"]
    columns = ["log_file", "span_idx", "name", "attributes", "span_json"]
    got, want = spark.read.parquet(str(tmp_path / "out")), ingest_spans(spark, str(logs))
    assert sorted(repr(r) for r in got.select(columns).collect()) == sorted(repr(r) for r in want.select(columns).collect())
