"""Session settings for waveform-sized rows, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import nightgrid

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(nightgrid)

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A waveform row is 24-72 kB: small Arrow batches keep Python workers near 20 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Rows of very different size (long texts, lists of members) are bounded by bytes as well.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.session.timeZone": "UTC",
}
# Static settings, only for sessions built here. Recording a Python stack for every column
# call costs more than planning these queries.
BUILD_ONLY = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


_LOCAL_ROOT: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "nightgrid", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **BUILD_ONLY, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a session that runs wholly in this process may go without one; it gets a folder of its
    own, removed when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOT.get("path")
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = _LOCAL_ROOT["path"] = tempfile.mkdtemp(prefix="nightgrid-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/nightgrid/{name}-{uuid.uuid4().hex}"


# Waveforms hardly repeat and hardly compress: no dictionary, the fastest codec, and row groups
# of about twenty epochs, so that a window read opens one or two of them.
WAVEFORM_OPTIONS = {"compression": "lz4_raw", "parquet.block.size": str(8 << 20),
                    "parquet.enable.dictionary#samples.list.element": "false"}


def table_options(df: DataFrame) -> dict[str, str]:
    return WAVEFORM_OPTIONS if "samples" in df.columns else {"compression": "zstd"}


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and continue from the written table."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**table_options(df)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables of ``write_once`` that nothing needs any more: what was made of them has been written.

    Only folders below this package's own part of the shared folder are touched.
    """
    for df in written:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/nightgrid/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow table (a few numbers and a short key) up to which it is sent to every task: some 40 MB.
SENT_ROWS = 500_000


def sent(narrow: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A narrow table marked for broadcast if counting shows at most ``rows`` rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(narrow) if narrow.limit(rows + 1).count() <= rows else narrow


#: Rows of a table (a few dozen short columns) that one task sorts or hashes at a time: some 100 MB.
TASK_ROWS = 250_000


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by their keys to as many tasks as there are ``rows`` rows in the table, so that a task's share does not grow with it.

    Grouping and joining by these keys, or grouping by more, needs no further exchange. No key may hold a large part of the rows.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)
