"""Streaming forms of log ingestion, the judgment ledger and the verdicts.

State is kept by Spark: keys within the watermark for the ledger, vote counts
per window for the verdicts. Progress lives in the checkpoint folder, so a
restarted stream goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from traceaudit.operators.judging import HARD, LEDGER_KEY, SOFT, NONE, POLICY_ABSENT, POLICY_PRESENT, reaches
from traceaudit.sources.files import locate
from traceaudit.sources.logsource import SPLIT_BYTES
from traceaudit.sources.spans import SMALL_BYTES, spans_of_files, spans_of_small_files


# Everything available now, then stop; pass ``{"processingTime": "1 minute"}`` as ``trigger`` to keep a stream running.
ONCE = {"availableNow": True}
_FILES = "spark.sql.streaming.checkpointFileManagerClass"
_BY_FILE_SYSTEM = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def ledger_stream(judgments: DataFrame, time: str = "ts", delay: str = "10 minutes",
                  key: Sequence[str] = LEDGER_KEY) -> DataFrame:
    """Judgments without repeats of a ledger key inside the watermark."""
    return judgments.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def consensus_stream(judgments: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "1 day",
                     threshold: float | None = None, order: str = "run_idx") -> DataFrame:
    """Consensus per trace, judge and window as votes come in.

    In append mode a window is final once the watermark passes it; votes that
    come later are dropped by Spark; the query progress counts them, combined
    per task and window, in ``numRowsDroppedByWatermark``. In update or complete mode every new vote
    refreshes its row. The share counts the votes present.
    """
    verdict, stage = F.col("judgment"), F.col("stage")
    votes = judgments.withWatermark(time, delay).groupBy(F.window(time, window), "trace_id", "judge_model").agg(
        F.count_if(stage == "j1").alias("n1"), F.count_if((stage == "j1") & (verdict == POLICY_ABSENT)).alias("a1"),
        F.count_if(stage == "j2").alias("n2"), F.count_if((stage == "j2") & (verdict == HARD)).alias("h"),
        F.count_if((stage == "j2") & (verdict == SOFT)).alias("s"),
        F.min(F.when((stage == "j2") & (verdict == HARD), F.col(order))).alias("fh"),
        F.min(F.when((stage == "j2") & (verdict == SOFT), F.col(order))).alias("fs"))
    one = reaches(F.col("a1"), F.col("n1"), threshold)
    two = reaches(F.col("h") + F.col("s"), F.col("n2"), threshold)
    hard = (F.col("h") > F.col("s")) | ((F.col("h") == F.col("s")) & (F.col("fh") < F.col("fs")))
    label: Column = F.when(two & (F.col("h") + F.col("s") > 0), F.when(hard, HARD).otherwise(SOFT))
    return votes.select(
        F.col("window.start").alias("window_start"), "trace_id", "judge_model",
        F.when(one, POLICY_ABSENT).otherwise(POLICY_PRESENT).alias("j1_consensus"),
        F.coalesce(label, F.lit(NONE)).alias("j2_consensus"), (one & label.isNotNull()).alias("accepted"))


def ingest_spans_stream(spark: SparkSession, path: str, target: str, checkpoint: str, glob: str = "*.log",
                        files_per_batch: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Read new logs as they appear and append their spans to a parquet table.

    Every micro-batch takes whole files, so span numbers are complete when a
    file is processed. The source carries names and sizes only; the files are read by the tasks that
    write their spans: small ones in one job, planned with the stream, larger ones by ranges in a second job.
    The batch number names the output folder; a batch that is
    run again after a failure replaces its own output.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    new = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", files_per_batch).load(path)
           .select("path", F.col("_metadata.file_path").alias("log_path"), "length"))
    # A task gets the bytes of a range at most, as far as the files are shared out evenly.
    spans = spans_of_small_files(new.coalesce(-(-files_per_batch * SMALL_BYTES // SPLIT_BYTES)), SMALL_BYTES)

    large_ones, is_small = F.count("later").alias("large"), F.col("later").isNull()    # made once, not in each batch

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        small = batch.observe(seen, large_ones).filter(is_small).drop("later")
        small.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if seen.get["large"]:
            large = batch.filter("later is not null").select("later.path", "log_path", "later.length")
            files = [tuple(row) for row in large.collect()]    # names and sizes of at most files_per_batch files
            spans_of_files(batch.sparkSession, files).write.mode("append").parquet(f"{target}/batch={number}")

    writer = spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE))
    return _started(spark, writer, checkpoint)


def _started(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Start a stream; one with a local checkpoint folder writes the files there without a process each that sets their mode.

    Spark's writer for local folders otherwise calls chmod for each of the files that a batch leaves. The setting is
    read as the stream begins and put back then; a folder elsewhere keeps the writer its file system asks for.
    """
    if locate(checkpoint)[2] != "file:":
        return writer.start()
    before = spark.conf.get(_FILES, None)
    if before is None:
        spark.conf.set(_FILES, _BY_FILE_SYSTEM)
    try:
        query = writer.start()
        until = time.monotonic() + 30
        while query.isActive and query.status["message"].startswith("Initializing") and time.monotonic() < until:
            time.sleep(0.01)
        return query
    finally:
        if before is None:
            spark.conf.unset(_FILES)


def append_stream(df: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a parquet table with everything available now."""
    return (df.writeStream.format("parquet").outputMode("append").option("path", target)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start())


def upsert_stream(df: DataFrame, target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each batch of an update stream to its own folder; the newest row of a key is in the highest batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or ONCE)).start())


def newest(rows: DataFrame, keys: Sequence[str], batch: str = "batch") -> DataFrame:
    """Latest version of every key written by :func:`upsert_stream`."""
    values = [c for c in rows.columns if c not in {*keys, batch}]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(batch)).alias("__row")).select(*keys, "__row.*")


def compact(spark: SparkSession, target: str, into: str, keys: Sequence[str], batch: str = "batch") -> None:
    """Rewrite the batches of :func:`upsert_stream` as one, the newest row of each key, in a new folder."""
    rows = spark.read.parquet(target)
    last = rows.agg(F.max(batch)).first()[0]
    newest(rows, keys, batch).write.mode("overwrite").parquet(f"{into}/{batch}={last}")
