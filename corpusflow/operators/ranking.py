"""Fusion, reranking, context rows and retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def relevance(distance: Column, similarity: bool = False) -> Column:
    """Score in [0, 1]: a distance of 0 is 1, of 2 is 0; similarities are clamped."""
    return clamp(distance if similarity else (2.0 - distance) / 2.0, 0.0, 1.0)


def relevance_percent(distance: Column) -> Column:
    return clamp((2.0 - distance) * 50, 0.0, 100.0)


def similarity_percent(similarity: Column) -> Column:
    return F.least(F.lit(100.0), similarity * 100)


def document_quality(text: Column, terms=V.PROFESSIONAL_TERMS) -> Column:
    hangul = T.matches(text, r"[\x{3131}-\x{3163}\x{AC00}-\x{D7A3}]").cast("int") * 0.2
    marks = T.contains_any(text, V.LIST_MARKS).cast("int") * 0.1
    return F.least(F.lit(1.0), 0.5 + hangul + marks + F.least(F.lit(0.2), T.count_contained(text, terms) * 0.05))


def length_score(length: Column) -> Column:
    return (
        F.when(length.between(200, 1000), 1.0)
        .when(((length >= 100) & (length < 200)) | ((length > 1000) & (length <= 1500)), 0.8)
        .when(((length >= 50) & (length < 100)) | ((length > 1500) & (length <= 2000)), 0.6)
        .otherwise(0.3)
    )


def metadata_quality(file_name: Column, chunk_id: Column, processing_method: Column, extraction_method: Column) -> Column:
    named = F.coalesce((F.length(file_name) > 5) & ~file_name.startswith("temp_"), F.lit(False))
    return F.least(
        F.lit(1.0),
        0.5
        + named.cast("int") * 0.2
        + chunk_id.isNotNull().cast("int") * 0.1
        + processing_method.isNotNull().cast("int") * 0.1
        + F.coalesce(extraction_method == "pypdf", F.lit(False)).cast("int") * 0.1,
    )


def hybrid_fusion(
    vector_hits: DataFrame, keyword_hits: DataFrame, k: int = V.TOP_K, key: str = "doc_id", query_key: str = "query_id",
    vector_weight: float = V.VECTOR_WEIGHT, keyword_weight: float = V.KEYWORD_WEIGHT,
) -> DataFrame:
    """(query_id, rank, key, score): weighted sum of two distances, a missing side counting 1; lower is better.

    Both inputs hold at most a few k rows per query.  Of several keyword rows for one key the last (`seq`) wins.
    """
    last = keyword_hits.groupBy(query_key, key).agg(F.max_by("distance", "seq").alias("_k"))
    left = vector_hits.select(query_key, key, F.col("distance").alias("_v"))
    merged = left.join(last, [query_key, key], "full_outer")
    score = F.round(
        F.coalesce("_v", F.lit(1.0)) * vector_weight + F.coalesce("_k", F.lit(1.0)) * keyword_weight, 8
    )
    order = Window.partitionBy(query_key).orderBy("score", key)
    ranked = merged.select(query_key, key, score.alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select(query_key, "rank", key, "score")


def drop_similar_results(
    results: DataFrame, text: str = "text", threshold: float = 0.9, query_key: str = "query_id"
) -> DataFrame:
    """Greedy keep-first near-duplicate filter inside each query's ranked results (at most k rows a query).

    The kept word sets of a query are folded in rank order inside one row; equal texts always collapse.
    """
    columns = [c for c in results.columns if c != query_key]
    packed = results.withColumn("_w", T.word_set(F.col(text))).groupBy(query_key).agg(
        F.sort_array(F.collect_list(F.struct("rank", *[c for c in columns if c != "rank"], "_w"))).alias("rows")
    )

    def step(kept: Column, row: Column) -> Column:
        repeated = F.exists(
            kept, lambda other: (other[text] == row[text]) | (T.jaccard(other["_w"], row["_w"]) > threshold)
        )
        return F.when(repeated, kept).otherwise(F.concat(kept, F.array(row)))

    start = F.slice(F.col("rows"), 1, 0)
    kept = packed.select(query_key, F.explode(F.aggregate("rows", start, step)).alias("r"))
    return kept.select(query_key, *(F.col(f"r.{c}").alias(c) for c in columns))


def rerank(
    results: DataFrame, text: str = "text", distance: str = "distance", query_key: str = "query_id", terms=V.PROFESSIONAL_TERMS
) -> DataFrame:
    """Rows re-ranked by 0.7 relevance + 0.1 quality + 0.1 length + 0.1 metadata; old rank breaks ties."""
    quality = document_quality(F.col(text), terms)
    meta = metadata_quality(*(F.col(c) for c in ("file_name", "chunk_id", "processing_method", "extraction_method")))
    final = (
        relevance(F.col(distance)) * 0.7 + quality * 0.1 + length_score(F.length(text)) * 0.1 + meta * 0.1
    )
    order = Window.partitionBy(query_key).orderBy(F.col("final_score").desc(), "rank")
    return (
        results.withColumn("document_quality", F.round(quality, 6))
        .withColumn("metadata_quality", F.round(meta, 6))
        .withColumn("final_score", F.round(final, 8))
        .withColumn("new_rank", F.row_number().over(order))
    )


def source_table(reranked: DataFrame, text: str = "text", distance: str = "distance", query_key: str = "query_id") -> DataFrame:
    """One row of eleven fields per result; `index` equals the label number of the context."""
    unknown = F.lit(V.UNKNOWN_NAME)
    return reranked.select(
        query_key,
        F.col("new_rank").alias("index"),
        F.coalesce("source", unknown).alias("source"),
        F.coalesce("file_name", unknown).alias("file_name"),
        F.coalesce(F.col("page").cast("string"), F.lit("N/A")).alias("page"),
        F.coalesce("chunk_id", F.concat(F.lit("chunk_"), F.col("new_rank") - 1)).alias("chunk_id"),
        F.round(relevance_percent(F.col(distance)), 6).alias("relevance_score"),
        F.length(text).alias("content_length"),
        F.coalesce("extraction_method", unknown).alias("extraction_method"),
        F.coalesce("processing_method", unknown).alias("processing_method"),
        "document_quality",
        "metadata_quality",
    )


def best_relevant_rank(results: DataFrame, golden: DataFrame, source: str, query_key: str = "query_id") -> DataFrame:
    """(query_id, best_rank): first rank whose source contains one of the query's expected strings, null if none.

    `golden` has an `expected` array per query; the join is by query, so only retrieved rows are tested.
    """
    wanted = golden.select(query_key, F.explode("expected").alias("_e"))
    tested = results.join(wanted, query_key).filter(F.col(source).contains(F.col("_e")))
    ranks = tested.groupBy(query_key).agg(F.min("rank").alias("best_rank"))
    return golden.select(query_key).join(ranks, query_key, "left")


def retrieval_metrics(ranks: DataFrame, k: int = 5, rank: str = "best_rank") -> DataFrame:
    """One row: cases, Hit@k and mean reciprocal rank; 0 for an empty set."""
    return ranks.agg(
        F.count("*").alias("cases"),
        F.coalesce(F.round(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), 6), F.lit(0.0)).alias("hit_at_k"),
        F.coalesce(F.round(F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), 6), F.lit(0.0)).alias("mrr"),
    )


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's lower-cased words that occur among the text's words."""
    asked = T.word_set(F.lower(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(
        F.size(F.array_intersect(asked, T.word_set(F.lower(text)))) / F.size(asked)
    )


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
