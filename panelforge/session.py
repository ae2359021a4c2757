"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "panelforge", master: str | None = None, shuffle_partitions: int | None = None, shuffled_gb: float | None = None
) -> SparkSession:
    """A session with adaptive execution on. ``master`` stays unset on a cluster, where spark-submit names it.

    ``shuffled_gb`` is the largest shuffle to expect: it is cut into partitions of about 128 MB at first, which adaptive
    execution only merges. Batches sent to Python are bounded in rows and in bytes.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shuffled_gb:
        first = max(200, round(shuffled_gb * 8))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(first))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a cluster without it is an error,
    because a machine-local folder would be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelforge-"))
    return context.getCheckpointDir()


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parked(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, however many later steps read them."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Reliable checkpoint, so that lost executors cannot change what was computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
