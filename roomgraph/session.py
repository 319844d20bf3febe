"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "roomgraph", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster the submitter sets the master, memory and shuffle partitions; only
    behaviour-relevant settings are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # keyed streams hold lists and timers, which Spark keeps in RocksDB only
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that lost executors never force a replay of every round.

    The folder is ``spark.checkpoint.dir``, which all executors must share. Only a local session
    that names none gets a temporary one. Spark's cleaner deletes a checkpoint once nothing refers
    to it any more (see ``build_session``).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="roomgraph-ckpt-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
