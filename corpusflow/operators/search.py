"""Search dispatch: lexical with a fallback, vector, or hybrid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import expansion, inverted, lexical, ranking, vector
from corpusflow.session import cut_lineage


Find = Callable[[DataFrame, int], DataFrame]  # (questions, k) -> (query_id, rank, doc_id, similarity, ...) from one index


def with_fallback(find: Find, queries: DataFrame, k: int = V.TOP_K, fallback_k: int = 5, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """Ranked results; queries without any are asked again with their first five content words."""
    found = cut_lineage(find(queries, k).select(query_key, "rank", key, "similarity"))
    missed = queries.join(found.select(query_key), query_key, "left_anti")
    reduced = missed.select(query_key, T.join(expansion.fallback_keywords(F.col("text")), " ").alias("text"))
    again = find(reduced, fallback_k).select(query_key, "rank", key, "similarity", F.lit(True).alias("fallback"))
    return found.withColumn("fallback", F.lit(False)).unionByName(again)


def rewritten(find: Find, vectors: Callable[[DataFrame], DataFrame], queries: DataFrame, rewrite: Callable[[Column, Column], Column], k: int = 8, first_k: int = 5) -> DataFrame:
    """Pseudo-relevance feedback: search, take the strongest terms of the first results, rewrite the question, search again.

    `vectors` gives the named weights of documents, `rewrite` the new text from the question and its related terms. The
    result has the rewritten text as `asked`. Both searches read the same index; the first one's rows are kept, so it runs once.
    """
    first = cut_lineage(find(queries, first_k))
    related = expansion.corpus_terms(first, vectors(first.select("doc_id").distinct()), queries).select("query_id", "terms")
    joined = queries.join(related, "query_id", "left")
    asked = cut_lineage(joined.select("query_id", rewrite(F.col("text"), F.coalesce("terms", F.array().cast("array<string>"))).alias("text")))
    return find(asked, k).join(asked.withColumnRenamed("text", "asked"), "query_id")


def dispatch(
    docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
    method: str = "mmr", k: int = V.TOP_K, key: str = "doc_id", index: str | None = None,
) -> DataFrame:
    """(query_id, rank, key, distance or score) by `hybrid`, `mmr` or `vector`; vectors carry the same key as docs.

    `index` is the folder of a stored index of the documents; without one their terms are counted again.
    """
    if method == "hybrid":
        near = vector.adaptive_threshold(vector.vector_top_k(vectors, query_vectors, k, key))
        words = inverted.keyword_hits(docs.sparkSession, index, queries, k) if index else lexical.keyword_hits(docs, queries, k, key)
        return ranking.hybrid_fusion(near, words, k, key)
    if method == "mmr":
        return vector.adaptive_threshold(vector.mmr(vectors, query_vectors, k, key=key))
    if method == "vector":
        return vector.adaptive_threshold(vector.vector_top_k(vectors, query_vectors, k, key))
    raise ValueError(f"unknown search method: {method}")
