"""Chunk store: parquet, one folder per write, each file's newest version being the current one.

A write never reads the store: it adds a folder of its own, so its cost is that of its own rows, and writing the same batch
again replaces the folder.  Which version of a file counts is decided when the store is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITE = "write_id"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has any folder; a damaged store exists and fails when it is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_chunks(chunks: DataFrame, path: str, write_id: str) -> None:
    """Write the chunks (file_id, version, chunk_id, ...) as the folder `write_id`; repeating a write changes nothing."""
    chunks.write.mode("overwrite").parquet(f"{path}/{WRITE}={write_id}")


def latest(versions: DataFrame, file: str = "file_id", version: str = "version", write: str = WRITE) -> DataFrame:
    """Rows of the newest version of every file; of several writes of one version, those of one write.

    The newest version comes from an aggregate that combines before the shuffle; a file may hold any share of the rows.
    """
    newest = versions.groupBy(file).agg(F.max(F.struct(version, write)).alias("_newest"))
    return versions.join(newest, file).filter((F.col(version) == F.col("_newest")[version]) & (F.col(write) == F.col("_newest")[write])).drop("_newest")


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The current chunks, or None when there is no store."""
    return latest(spark.read.parquet(path)) if exists(spark, path) else None


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(file_id, version): what the store holds; reads two columns."""
    return spark.read.parquet(path).select("file_id", "version").distinct() if exists(spark, path) else None


def count_chunks(spark: SparkSession, path: str) -> int:
    stored = read_store(spark, path)
    return 0 if stored is None else stored.count()


def clear_store(spark: SparkSession, path: str) -> None:
    """Remove all folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
