"""Session settings and the durable folder used to cut lineage."""

from __future__ import annotations

import sys
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on; everything else is left to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started from; once per context."""
    context = spark.sparkContext
    if getattr(context, "_traceaudit_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="traceaudit-py-")) / "traceaudit_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(here.rglob("*.py")):
            archive.write(source, source.relative_to(here.parent))
    context.addPyFile(str(target))
    context._traceaudit_shipped = True


def send_whole(*modules: str) -> None:
    """Send what these modules define with the code that uses it, to workers that see no added files: sources and state of streams."""
    from pyspark import cloudpickle
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session and make the package known to its workers."""
    ship_package(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "traceaudit", **conf: str) -> SparkSession:
    """Small local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Call sites of single expressions cost the driver a round trip each (a static setting).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable_dir(spark: SparkSession) -> str:
    """Folder all executors share, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a
    cluster a missing setting is an error, because a machine-local folder dies
    with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="traceaudit-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def unsized(spark: SparkSession, places: pa.Table) -> DataFrame:
    """Places to read, such as ranges of files, as rows whose size the planner takes as unknown.

    What is read there can be larger than the list by any factor. By the list's size
    a plan would broadcast it; as it is, joins are chosen by what the shuffles have written.
    """
    name = "spark.sql.execution.arrow.localRelationThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")                              # an RDD, never a local relation of known size
    try:
        return spark.createDataFrame(places)
    finally:
        spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows survive lost executors and keep one physical order."""
    spark = df.sparkSession
    folder = durable_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
