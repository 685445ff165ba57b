"""Incremental ingestion: files of a folder become chunks of a store.

Files are told apart by their whole path.  Every file ends in one column of the report: refused, failed, too short, or
ingested.  The cost of a batch is that of its own files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import chunking
from corpusflow.operators.lexical import explode_once
from corpusflow.sources import files, store

SHORTEST = 100


def file_id(path: Column) -> Column:
    return F.sha2(path, 256)


def chunk_files(decoded: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Cleaned and chunked files; the chunk id carries the path's digest, so equal names in two folders stay apart.

    Cleaning runs once for each row; what is joined back to the chunks are the files' names, not their texts.
    """
    number = F.xxhash64("path").alias("doc_id")
    text = F.when(F.col("extension") == "md", T.preprocess(F.col("text"), markdown=True)).otherwise(T.preprocess(F.col("text")))
    cleaned = explode_once(decoded.select(number, F.array(text).alias("texts")), "texts", "text")
    chunks = chunking.chunk_documents(cleaned.filter(F.length(T.strip(F.col("text"))) >= SHORTEST), size=size, overlap=overlap)
    named = decoded.select(number, file_id(F.col("path")).alias("file_id"), "path", "file_name", F.col("modified").alias("version"))
    return chunks.join(named, "doc_id").drop("doc_id").withColumn("chunk_id", F.format_string("%s_%04d", "file_id", "chunk_index"))


def write_files(listed: DataFrame, store_path: str, report_path: str, write_id: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> None:
    """Admit, decode and chunk the listed files, write their chunks as one write of the store and one row of the report."""
    name = F.element_at(F.split("path", "/"), -1)
    checked = listed.withColumn("refused", files.admission(name, F.col("length")))
    decoded = files.decode(checked.filter(F.col("refused").isNull())).persist()
    try:
        good = decoded.filter(F.col("error").isNull())
        store.write_chunks(chunk_files(good, size, overlap), store_path, write_id)
        written = listed.sparkSession.read.parquet(f"{store_path}/{store.WRITE}={write_id}")
        counts = written.agg(F.count_distinct("file_id").alias("ingested"), F.count(F.lit(1)).alias("new_chunks"))
        seen = checked.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("refused").isNotNull()).alias("refused"))
        failed = decoded.agg(F.count_if(F.col("error").isNotNull()).alias("failed"))
        report = seen.crossJoin(failed).crossJoin(counts)  # three single rows
        report = report.select(
            F.lit(write_id).alias("write_id"), "files", "refused", "failed",
            (F.col("files") - F.col("refused") - F.col("failed") - F.col("ingested")).alias("too_short"), "ingested", "new_chunks",
        )
        report.coalesce(1).write.mode("overwrite").parquet(f"{report_path}/part={write_id}")
    finally:
        decoded.unpersist()


def ingest_changed(
    spark: SparkSession, folder: str, store_path: str, report_path: str, write_id: str, types=("txt", "md"),
    size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP,
) -> None:
    """Ingest the files that are new or have changed since the store took them; their new chunks replace the old ones."""
    listed = files.read_files(spark, folder, types)
    held = store.versions(spark, store_path)
    if held is not None:
        known = held.select(F.col("file_id").alias("_id"), F.col("version").alias("_version"))
        listed = listed.join(known, (file_id(F.col("path")) == F.col("_id")) & (F.col("modificationTime") == F.col("_version")), "left_anti")
    write_files(listed, store_path, report_path, write_id, size, overlap)


def ingest(
    spark: SparkSession, folder: str, store_path: str, report_path: str, checkpoint: str, types=("txt", "md"),
    size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, max_files: int = 1000,
) -> StreamingQuery:
    """Read the files that are new to the stream and write them as batches; stops when nothing is left.

    A batch is written under the stream's own id and its number, so a replayed batch replaces itself.  The stream takes a
    path once; files that change under the same path are for `ingest_changed`.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema(files.BINARY_SCHEMA)
        .option("pathGlobFilter", "*.{" + ",".join(types) + "}")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )

    def batch(df: DataFrame, batch_id: int) -> None:
        stream_id = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_files(df, store_path, report_path, f"{stream_id}-{batch_id}", size, overlap)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
