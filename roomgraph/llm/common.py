"""Shared folder, stored intermediate tables and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. A batch lies in a Python worker as a whole, so this bounds its memory.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the written files, so a lost executor never replays what led to them, and
    partitions read from them hold the same rows in the same order each time. Nothing needs the
    shuffles behind them any more; a collection on the driver lets Spark's cleaner delete their
    files now and not at the end of the job.
    """
    folder = shared_dir(df.sparkSession)
    df.write.parquet(folder)
    df.sparkSession._jvm.System.gc()
    again = df.sparkSession.read.schema(df.schema).parquet(folder)
    again._stored_in = folder
    return again


def few_files(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df``, whose size goes with ``rows``, in about ``each`` of them a partition, but two tasks a
    core at least: small tables aren't scattered over hundreds of near-empty files, large ones keep
    all their partitions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(2 * cores, rows // each + 1))


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    drop_folder(df.sparkSession, df._stored_in)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole, long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this scope an Arrow batch holds ``rows`` rows at most; afterwards the caller's own
    setting holds again. What shall run with it must be stored inside the scope."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(max(1, rows)))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def sound_vector(column: str) -> Column:
    """Whether an array<double> is there, not empty and without null or non-finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & finite, F.lit(False))


def usual_length(rows: DataFrame, column: str) -> int:
    """The commonest length of the arrays in ``column``, the smallest of equally common ones; 0 if
    there are no rows."""
    most = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").head()
    return most.n if most else 0


def floored(column: str, scale: int) -> Column:
    """Components x as integers floor(scale * x); an error where one does not fit in 31 bits."""
    def whole(x: Column) -> Column:
        value = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x) < F.lit(2.0 ** 31 / scale), value).otherwise(
            F.raise_error(F.lit(f"a component times {scale} does not fit in 31 bits")).cast("long"))
    return F.transform(column, whole)
