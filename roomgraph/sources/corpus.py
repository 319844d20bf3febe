"""Knowledge corpus: text files to a chunk table, versions and the active one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgraph.functions.answers import chunks


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``*.txt`` or ``*.md`` file below a folder: source (relative path) and text."""
    files = spark.read.option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.{txt,md,TXT,MD}"
    ).text(folder, wholetext=True)
    root = folder.rstrip("/") + "/"
    path = F.url_decode(F.col("_metadata.file_path"))
    return files.select(
        F.element_at(F.split(path, root, 2), -1).alias("source"), F.col("value").alias("text")
    )


def chunk_table(documents: DataFrame, size: int = 500, overlap: int = 60) -> DataFrame:
    """Chunks of each document with ``id`` = source#number."""
    return documents.select(
        *[c for c in documents.columns if c != "text"],
        F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk", "text"),
    ).withColumn("id", F.concat("source", F.lit("#"), F.col("chunk").cast("string")))


def manifest(chunked: DataFrame) -> DataFrame:
    """Chunk count per document."""
    return chunked.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def write_version(chunked: DataFrame, folder: str, version: str) -> None:
    """Write one version of the chunk table and its manifest."""
    chunked.write.mode("overwrite").parquet(f"{folder}/chunks/version={version}")
    stored = chunked.sparkSession.read.parquet(f"{folder}/chunks/version={version}")
    manifest(stored).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")


def activate(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version the one that readers see."""
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").json(
        f"{folder}/active"
    )


def active_chunks(spark: SparkSession, folder: str) -> DataFrame:
    current = spark.read.schema("version string").json(f"{folder}/active")
    chunked = spark.read.option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks")
    return chunked.withColumn("version", F.col("version").cast("string")).join(
        F.broadcast(current), "version", "left_semi"
    )
