"""Lexical retrieval: corpus statistics, TF-IDF cosine and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import scoring
from corpusflow.session import MAX_BROADCAST_ROWS, cut_lineage, within


def index_terms(text: Column, bigrams: bool = True, stopwords=V.CLEAN_STOPWORDS) -> Column:
    """Unigrams and adjacent bigrams of the indexed form of a text."""
    words = F.filter(T.tokens(text), lambda w: ~w.isin(*stopwords))
    return with_pairs(words) if bigrams else words


def with_pairs(words: Column) -> Column:
    """Words, then pairs of adjacent ones."""
    return T.let(
        words,
        lambda w: F.concat(
            w,
            F.zip_with(
                F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ),
    )


def explode_once(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of an array column that is expensive to compute.

    For a plain explode the optimizer adds a filter on the array's size below it, which computes the array again; the
    outer form has no such filter.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def postings(docs: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """(key, term, tf).  The histogram is taken inside the row, so building postings needs no shuffle."""
    counted = docs.select(key, T.run_lengths(terms).alias("h"))
    return explode_once(counted, "h", "p").select(
        key, F.col("p.item").alias("term"), F.col("p.n").alias("tf")
    )


def term_statistics(post: DataFrame) -> DataFrame:
    """(term, df, corpus_tf); both are sums, so frequent terms are combined before the shuffle."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("corpus_tf"))


def features(docs: DataFrame, terms: Column, key: str = "doc_id", max_features: int = V.MAX_FEATURES) -> DataFrame:
    """(term, df, corpus_tf, idf) of the most frequent terms, with smooth idf.  At most max_features rows."""
    n = docs.count()
    top = (
        term_statistics(postings(docs, terms, key))
        .orderBy(F.col("corpus_tf").desc(), "term")
        .limit(max_features)
    )
    return top.withColumn("idf", F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1.0)


def term_weights(docs: DataFrame, terms: Column, feats: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, terms, weights): L2-normalised TF-IDF vectors with term ids of the feature table; rows without any are left out.

    A document's histogram is weighted in its own row: the feature table has at most max_features rows, so every task
    looks terms up in it, a whole Arrow batch at a time, and no posting leaves its document.
    """
    known = feats.select("term", "term_id", "idf").toPandas()
    values, ids, idf = pa.array(known["term"], pa.string()), known["term_id"].to_numpy(np.int32), known["idf"].to_numpy(np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, counts = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
            at = pc.index_in(flat.field("item"), values)
            held = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), counts)[held]
            place = at.drop_null().to_numpy()
            raw = flat.field("n").to_numpy()[held] * idf[place]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=len(batch)))
            sizes = np.bincount(row, minlength=len(batch))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            made = [pa.ListArray.from_arrays(offsets, pa.array(column)) for column in (ids[place], raw / norm[row])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [key, "terms", "weights"]).filter(pa.array(sizes > 0))

    kind = dict(docs.dtypes)[key]
    histograms = docs.select(key, T.run_lengths(terms).alias("h"))
    return histograms.mapInArrow(weigh, f"{key} {kind}, terms array<int>, weights array<double>")


def numbered(feats: DataFrame) -> DataFrame:
    """Features with a dense integer id; the input is bounded by max_features, so one task numbers it."""
    spark = feats.sparkSession
    rows = [(r["term"], i, r["df"], r["corpus_tf"], r["idf"]) for i, r in enumerate(feats.collect())]
    return spark.createDataFrame(rows, "term string, term_id int, df bigint, corpus_tf bigint, idf double")


def tfidf_top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = V.TOP_K,
    key: str = "doc_id",
    query_key: str = "query_id",
    max_features: int = V.MAX_FEATURES,
    min_similarity: float = V.MIN_SIMILARITY,
    bigrams: bool = True,
) -> DataFrame:
    """(query_id, rank, doc_id, similarity, distance): cosine of TF-IDF vectors, similarity above the minimum."""
    terms = index_terms(F.col("text"), bigrams)
    feats = numbered(features(docs, terms, key, max_features))
    rows = term_weights(docs, terms, feats, key).withColumnRenamed(key, "id")
    wanted = term_weights(queries, terms, feats, query_key).withColumnRenamed(query_key, "query_id")
    top = scoring.top_k(rows, wanted, scoring.sparse_product, k, largest=True)
    return (
        top.filter(F.col("score") > min_similarity)
        .select(
            F.col("query_id").alias(query_key), "rank", F.col("id").alias(key), F.col("score").alias("similarity"),
            F.round(1 - F.col("score"), 6).alias("distance"),
        )
    )


def bm25_top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = V.TOP_K,
    key: str = "doc_id",
    query_key: str = "query_id",
    k1: float = V.BM25_K1,
    b: float = V.BM25_B,
    epsilon: float = 0.25,
    constant: float | None = None,
) -> DataFrame:
    """(query_id, rank, doc_id, score): Okapi BM25 over whitespace words.

    A negative idf becomes epsilon times the mean idf.  `constant` replaces every score, keeping the ranking.
    """
    words = T.split_words(F.col("text"))
    sizes = docs.select(F.size(words).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    stats = cut_lineage(
        term_statistics(postings(docs, words, key)).select(
            "term", (F.log(sizes["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")
        )
    )
    mean_idf = stats.agg(F.avg("idf")).first()[0] or 0.0
    asked = postings(queries, words, query_key)
    distinct = asked.select("term").distinct()
    idf = stats.join(_maybe_broadcast(distinct), "term", "left_semi").select(
        "term",
        F.xxhash64("term").alias("term_id"),
        F.when(F.col("idf") < 0, epsilon * mean_idf).otherwise(F.col("idf")).alias("idf"),
    )
    idf = _maybe_broadcast(idf)
    saturation = F.col("tf") + k1 * (1 - b + b * F.col("dl") / sizes["avgdl"])
    hits = (
        # sizes and histograms come before the explode: beside it they would be evaluated once per exploded row
        docs.select(key, F.size(words).alias("dl"), T.run_lengths(words).alias("h"))
        .transform(explode_once, "h", "p")
        .select(key, "dl", F.col("p.item").alias("term"), F.col("p.n").alias("tf"))
        .join(idf, "term")
        .select(key, "term_id", (F.col("idf") * F.col("tf") * (k1 + 1) / saturation).alias("w"))
    )
    rows = _gather(hits, key).withColumnRenamed(key, "id")
    wanted = _gather(
        asked.select(query_key, F.xxhash64("term").alias("term_id"), F.col("tf").cast("double").alias("w")), query_key
    ).withColumnRenamed(query_key, "query_id")
    top = scoring.top_k(rows, wanted, scoring.sparse_product, k, largest=True)
    score = F.lit(constant) if constant is not None else F.col("score")
    return top.select(F.col("query_id").alias(query_key), "rank", F.col("id").alias(key), score.alias("score"))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast behind a size check; a plain (sort-merge, skew-handled) join side beyond it."""
    return F.broadcast(df) if within(df, MAX_BROADCAST_ROWS) else df


def _gather(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key).agg(F.collect_list(F.struct("term_id", "w")).alias("v")).select(
        key, F.col("v.term_id").alias("terms"), F.col("v.w").alias("weights")
    )


def keyword_hits(
    docs: DataFrame, queries: DataFrame, k: int = V.TOP_K, key: str = "doc_id", query_key: str = "query_id",
    constant: float | None = 0.5, max_features: int = V.MAX_FEATURES,
) -> DataFrame:
    """Keyword list: BM25 rows (with a constant distance) followed by TF-IDF rows; `seq` keeps that order."""
    lexical = bm25_top_k(docs, queries, k, key, query_key, constant=constant).select(
        query_key, key, F.col("score").alias("distance"), F.lit("bm25").alias("source"), F.col("rank").alias("seq")
    )
    tfidf = tfidf_top_k(docs, queries, k, key, query_key, max_features).select(
        query_key, key, "distance", F.lit("tfidf").alias("source"), (F.col("rank") + k).alias("seq")
    )
    return lexical.unionByName(tfidf)


def unit_vectors(post: DataFrame, feats: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words, weights) of postings (key, term, tf): weighted by the features and normalised."""
    raw = post.join(F.broadcast(feats), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))  # at most max_features rows
    vectors = raw.groupBy(key).agg(
        F.collect_list(F.struct("term", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    return vectors.select(key, F.col("v.term").alias("words"), F.transform("v.w", lambda w: w / F.col("norm")).alias("weights"))


def named_weights(docs: DataFrame, terms: Column, feats: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words, weights): like term_weights with the terms themselves, for the few documents of a result list."""
    return unit_vectors(postings(docs, terms, key), feats, key)
