"""Helpers shared by the corpus operators: table access, stored tables, row keys."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceaudit.session import durable_dir, tune

# White space of the word rules: blank and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

# Texts may be long: few rows, and few bytes, go to a Python worker at a time.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_STORED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the session tuned for the operators."""
    tune(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and leaves joins free to choose
    their own partitioning. :func:`tidied` removes what a step no longer needs,
    :func:`clear_stored` all folders.
    """
    path = f"{durable_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(step: Callable) -> Callable:
    """A step that deletes the tables stored while it ran, but those that its results still read.

    A step returns a DataFrame or a tuple of them, and perhaps other values. Once its tables are gone
    nothing can read the shuffles behind them either; a collection in the
    driver's JVM lets Spark's cleaner drop those from the executors' disks.
    """

    @functools.wraps(step)
    def run(*args, **kwargs):
        begin = len(_STORED)
        result = step(*args, **kwargs)
        frames = [x for x in (result if isinstance(result, tuple) else (result,)) if isinstance(x, DataFrame)]
        read = {file.rsplit("/", 1)[0].rsplit("/", 1)[-1] for frame in frames for file in frame.inputFiles()}
        needed = [path for path in _STORED[begin:] if path.rsplit("/", 1)[-1] in read]
        spent = [path for path in _STORED[begin:] if path not in needed]
        if spent:
            spark = frames[0].sparkSession
            for path in spent:
                _delete(spark, path)
            _STORED[begin:] = needed
            spark._jvm.System.gc()
        return result

    return run


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that :func:`stored` has written in this process; returns how many."""
    done = 0
    while _STORED:
        done += bool(_delete(spark, _STORED.pop()))
    return done


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def document_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns ``_id`` and ``_h`` that tell documents apart, also with null or repeated ids.

    Rows that agree in both are the same document repeated.
    """
    return [docs[doc_id].alias("_id"), F.xxhash64(docs[text].isNull(), docs[text]).alias("_h")]


def hash31(*columns: Column) -> Column:
    """A number from 0 to 2**31-1 that depends on nothing but the values; the same in DuckDB.

    It is the start of the md5 of the values as text, joined by bars.
    """
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), 1)
