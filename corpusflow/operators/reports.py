"""Counters and report rows: tokens, context budgets, batches, loads and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.session import cut_lineage


def numbered(df: DataFrame, order: str, keys: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """Zero-based position of every row by an order column, within keys or over the whole table.

    Rows are range-partitioned by keys and order, numbered inside a range and shifted by the counts of the ranges before
    it.  The ranges follow the rows, not the values, so sparse ids and a key with a third of all rows are spread evenly.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(parts, *keys, order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").count()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    placed = ranged.withColumn("_n", F.row_number().over(inside)).join(shift, [*keys, "_range"])
    return placed.withColumn(name, F.col("_shift") + F.col("_n") - 1).drop("_range", "_shift", "_n")


def batches(files: DataFrame, size: int = 10, order: str = "doc_id") -> DataFrame:
    """Rows with the number of their batch of `size`, in order."""
    return numbered(files, order, name="_p").withColumn("batch_no", F.floor(F.col("_p") / size)).drop("_p")


def tokens(text: Column) -> Column:
    """Estimate of four characters per token."""
    return F.floor(F.length(text) / V.CHARS_PER_TOKEN).cast("bigint")


def message_overhead(model: Column) -> Column:
    return F.when(model.contains("gpt-3.5") | model.contains("gpt-4"), 3).otherwise(4)


def conversation_tokens(messages: DataFrame, model: Column, key: str = "conv_id") -> DataFrame:
    """(key, messages_tokens): overhead, role and text of every message, and three for the reply."""
    one = message_overhead(model) + tokens(F.col("role")) + tokens(F.col("text"))
    return messages.groupBy(key).agg((F.sum(one) + 3).alias("messages_tokens"))


def model_limits(spark) -> DataFrame:
    return spark.createDataFrame(list(V.MODEL_LIMITS), "provider string, model string, max_tokens bigint")


def max_context(provider: Column, model: Column) -> Column:
    """Context size of a model, of the provider's first model if it is unknown, or a default."""
    first: dict[str, int] = {}
    known, fallback = F, F
    for p, m, limit in V.MODEL_LIMITS:
        known = known.when((provider == p) & (model == m), limit)
        first.setdefault(p, limit)
    for p, limit in first.items():
        fallback = fallback.when(provider == p, limit)
    return F.coalesce(known.otherwise(F.lit(None)), fallback.otherwise(F.lit(V.DEFAULT_MODEL_LIMIT)))


def context_usage(rows: DataFrame, provider: str = "provider", model: str = "model") -> DataFrame:
    """Adds total, limit, remaining, percent, over-limit flag and a status to message and document token counts."""
    total = F.col("messages_tokens") + F.col("documents_tokens") + V.SYSTEM_PROMPT_TOKENS
    limited = rows.withColumn("total_tokens", total).withColumn("max_tokens", max_context(F.col(provider), F.col(model)))
    percent = F.col("total_tokens") / F.col("max_tokens") * 100
    return limited.select(
        "*", (F.col("max_tokens") - F.col("total_tokens")).alias("remaining_tokens"), F.round(percent, 6).alias("usage_percentage"),
        (F.col("total_tokens") > F.col("max_tokens")).alias("is_over_limit"),
        F.when(F.col("total_tokens") > F.col("max_tokens"), "🔴 초과").when(percent > 80, "🟡 주의").otherwise("🟢 정상").alias("status"),
    )


def context_budget(window: Column, output: Column, provider: Column, model: Column) -> Column:
    """Characters of context a model takes: seventy percent of the free tokens at four characters each, within limits."""
    prompt = F.when(provider == "local", V.PROMPT_TOKENS["local"]).otherwise(V.PROMPT_TOKENS["default"])
    low = F.when(provider == "local", V.MIN_CONTEXT["local"]).otherwise(V.MIN_CONTEXT["default"])
    high = F.when((provider == "openai") & model.contains("gpt-3.5"), V.MAX_CONTEXT["gpt-3.5"]).otherwise(V.MAX_CONTEXT["default"])
    free = ((window - output - prompt) * V.SAFETY_MARGIN).cast("bigint") * V.CHARS_PER_TOKEN
    return F.greatest(low, F.least(high, free))


def load_status(loads: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, original_length, processed_length, document_count, success, error) of the pieces each load produced."""
    rows = loads.groupBy(key).agg(
        F.max("original_length").alias("original_length"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("processed_length"),
        F.count("text").alias("document_count"),
    )
    ok = F.col("document_count") > 0
    return rows.select("*", ok.alias("success"), F.when(~ok, "문서를 추출할 수 없습니다").alias("error"))


def rebuild_report(files: DataFrame) -> DataFrame:
    """One row over per-file rows (success, chunks, processing_time): totals; errors stay in the per-file table."""
    return files.agg(
        F.count("*").alias("total_files"), F.count_if("success").alias("processed_files"), F.count_if(~F.col("success")).alias("failed_files"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("chunks"))), F.lit(0)).alias("total_chunks"),
        F.round(F.sum("processing_time"), 6).alias("processing_time"),
    )


def store_statistics(chunks: DataFrame, vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: chunks, vectors, dimension and the thresholds in force."""
    left = chunks.agg(F.count("*").alias("total_documents"))
    right = vectors.agg(F.count("*").alias("total_vectors"), F.max(F.size(column)).alias("dimension"))
    one = F.lit(1).alias("_1")
    return left.select("*", one).join(right.select("*", one), "_1").drop("_1").select(
        "*", F.lit(V.DISTANCE_THRESHOLD).alias("distance_threshold"), F.lit(V.SIMILARITY_THRESHOLD).alias("similarity_threshold"),
        (F.col("total_documents") > 0).alias("keyword_search_available"),
    )


def store_records(chunks: DataFrame, identifier: Column, content: str = "text") -> DataFrame:
    """(id, content, metadata): records for a store, the metadata as JSON of all other columns."""
    rest = [c for c in chunks.columns if c != content]
    return chunks.select(identifier.alias("id"), F.col(content).alias("content"), F.to_json(F.struct(*rest)).alias("metadata"))


def compare_outputs(a: DataFrame, b: DataFrame, quality, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two versions of each document side by side: lengths, lines, quality, relative improvement in percent."""

    def measured(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            key, F.length(text).alias(f"{name}_length"), F.size(T.lines(F.col(text))).alias(f"{name}_lines"),
            F.round(quality(F.col(text)), 6).alias(f"{name}_quality"),
        )

    joined = measured(a, "first").join(measured(b, "second"), key)
    gain = (F.col("first_quality") - F.col("second_quality")) / F.greatest(F.col("second_quality"), F.lit(0.1)) * 100
    return joined.withColumn("improvement", F.round(gain, 6))


def upload_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: method of its first chunk and chunk totals."""
    return chunks.groupBy(key).agg(
        F.min_by("processing_method", "chunk_index").alias("processing_method"), F.count("*").alias("chunks"),
        F.sum("chunk_size").alias("characters"),
    )
