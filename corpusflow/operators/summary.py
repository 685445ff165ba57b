"""Extractive summaries: key sentences, length fitting, importance, levels and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import arrow_text
from corpusflow.functions import sentences as L
from corpusflow.functions import text as T
from corpusflow.operators import ranking
from corpusflow.session import cut_lineage


ROWS_AT_ONCE = 256


def _weights(lists: pa.ListArray, total: np.ndarray, sentence_of: np.ndarray, n_sentences: int, asked: pa.ListArray | None) -> np.ndarray:
    """Scores of the sentences of a few documents; NaN for sentences without a term.

    `lists` has the tokens of every sentence, `sentence_of` the document of every sentence, `total` the number of sentences
    of every document and `asked` the tokens of every document's question.
    """
    own = lists.flatten().dictionary_encode()
    width = max(len(own.dictionary), 1)
    cells, tf = np.unique(arrow_text.rows_of(lists) * width + own.indices.to_numpy().astype(np.int64), return_counts=True)
    sentence = cells // width
    terms = sentence_of[sentence] * width + cells % width  # a term of a document
    known, at, df = np.unique(terms, return_inverse=True, return_counts=True)
    idf = np.log((total[known // width] + 1.0) / (df + 1.0)) + 1.0
    w = tf * idf[at]
    norm = np.sqrt(np.bincount(sentence, w * w, minlength=n_sentences))
    with np.errstate(invalid="ignore", divide="ignore"):
        score = 0.7 * np.bincount(sentence, w, minlength=n_sentences) / norm
        if asked is not None and len(known):
            code = pc.index_in(asked.flatten(), own.dictionary)
            held = code.is_valid().to_numpy(zero_copy_only=False)
            wanted, qtf = np.unique(arrow_text.rows_of(asked)[held] * width + code.drop_null().to_numpy(), return_counts=True)
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[place] == wanted
            place, qw = place[hit], qtf[hit] * idf[place[hit]]
            q = np.zeros(len(known))
            q[place] = qw / np.sqrt(np.bincount(known[place] // width, qw * qw, minlength=len(total)))[known[place] // width]
            score += 0.3 * np.bincount(sentence, w * q[at], minlength=n_sentences) / norm
    return np.round(score, 6)


def _choose(n: int, kept: int, asking: bool, stopwords):
    """Adds the chosen sentences to the first `kept` columns; the sentences, lowered, and the lowered question follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                lists, lowered = batch.column(kept), batch.column(kept + 1).flatten()
                size = lists.value_lengths().fill_null(0).to_numpy()
                row = arrow_text.rows_of(lists)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                tried = np.flatnonzero(size[row] > n)
                asked = arrow_text.tokens(batch.column(kept + 2), stopwords) if asking else None
                score = np.full(len(row), np.nan)
                score[tried] = _weights(arrow_text.tokens(lowered.take(pa.array(tried)), stopwords), size, row[tried], len(tried), asked)
                order = np.lexsort((place, -score, row))  # NaN last
                rank = np.empty(len(row), np.int64)
                rank[order] = place
                held = np.flatnonzero((size[row] <= n) | ((rank < n) & ~np.isnan(score)))
                chosen = arrow_text.lists_of(lists.flatten().take(pa.array(held)), row[held], len(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], chosen], [*batch.schema.names[:kept], "sentences"])

    return run


def with_key_sentences(docs: DataFrame, n: int = 5, text: str = "text", query: str | None = None, stopwords=("",)) -> DataFrame:
    """Adds `sentences`: the n sentences of highest TF-IDF mass, in their own order; all when there are no more than n.

    Idf is per document, so everything is decided in the row, a few hundred documents at a time; nothing is shuffled.
    """
    sentences = F.when(T.strip(F.col(text)) != "", L.split_at_spaces(F.col(text)))
    split = docs.withColumn("_s", sentences)
    lowered = [F.transform("_s", F.lower).alias("_l"), *([F.lower(query).alias("_q")] if query else [])]
    schema = docs.withColumn("sentences", F.array().cast("array<string>")).schema
    return split.select(*docs.columns, "_s", *lowered).mapInArrow(_choose(n, len(docs.columns), query is not None, tuple(w for w in stopwords if w)), schema)


def key_sentences(
    docs: DataFrame, n: int = 5, key: str = "doc_id", text: str = "text", query: str | None = None, stopwords=("",)
) -> DataFrame:
    """(key, sentences) of the documents with text, as with_key_sentences gives them."""
    rows = docs.filter(T.strip(F.col(text)) != "").select(*dict.fromkeys([key, text, *([query] if query else [])]))
    return with_key_sentences(rows, n, text, query, stopwords).select(key, "sentences")


def extractive_summary(sentences: Column, target: Column | int) -> Column:
    """Sentences up to the target length; the first that does not fit is cut at a word when over fifty characters remain."""
    limit = F.lit(target) if isinstance(target, int) else target

    def step(acc: Column, s: Column) -> Column:
        remaining = limit - acc["used"]
        fits = F.length(s) <= remaining
        partial = F.concat(T.sub(F.left(s, remaining), r" [^ ]*$"), F.lit("..."))
        parts = (
            F.when(acc["done"], acc["parts"])
            .when(fits, F.concat(acc["parts"], F.array(s)))
            .when(remaining > 50, F.concat(acc["parts"], F.array(partial)))
            .otherwise(acc["parts"])
        )
        return F.struct(
            parts.alias("parts"), F.when(~acc["done"] & fits, acc["used"] + F.length(s)).otherwise(acc["used"]).alias("used"),
            (acc["done"] | ~fits).alias("done"),
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("done"))
    return F.aggregate(sentences, start, step, lambda acc: T.join(acc["parts"], " "))


def fitted_sentences(sentences: Column, summary: Column, target: Column | int) -> Column:
    """The summary if it fits; else whole key sentences up to the target; else the start of the summary."""
    limit = F.lit(target) if isinstance(target, int) else target

    def step(acc: Column, s: Column) -> Column:
        fits = ~acc["done"] & (acc["used"] + F.length(s) <= limit)
        return F.struct(
            F.when(fits, F.concat(acc["parts"], F.array(s))).otherwise(acc["parts"]).alias("parts"),
            F.when(fits, acc["used"] + F.length(s)).otherwise(acc["used"]).alias("used"), (~fits).alias("done"),
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("done"))
    whole = F.aggregate(sentences, start, step, lambda acc: acc["parts"])
    return F.when(F.length(summary) <= limit, summary).otherwise(
        T.let(whole, lambda w: F.when(F.size(w) > 0, T.join(w, " ")).otherwise(F.left(summary, limit)))
    )


def importance(text: Column, query: Column | None = None) -> Column:
    length = F.least(F.lit(1.0), F.length(text) / 1000)
    overlap = ranking.overlap_score(query, text) if query is not None else F.lit(0.0)
    facts = sum((T.count_matches(text, p) for p in V.INFO_PATTERNS), F.lit(0))
    return F.when(T.strip(text) == "", 0.0).otherwise(length * 0.3 + overlap * 0.5 + F.least(F.lit(1.0), facts / 10) * 0.2)


def summary_length(max_output_tokens: Column, default: int = 500, minimum: int = 150) -> Column:
    return F.when(max_output_tokens <= 0, default).otherwise(
        F.greatest(F.lit(minimum), F.least(F.lit(default), max_output_tokens))
    )


def summaries(
    docs: DataFrame, target: Column | int = 500, n: int = 5, key: str = "doc_id", text: str = "text", query: str | None = None
) -> DataFrame:
    """(key, sentences, summary, importance_score, compression_ratio, original_length)."""
    rows = docs.select(*dict.fromkeys([key, text, *([query] if query else [])]))
    out = with_key_sentences(rows, n, text, query).withColumn("summary", extractive_summary(F.col("sentences"), target))
    return out.select(
        key, "sentences", "summary", F.round(importance(F.col(text), F.col(query) if query else None), 6).alias("importance_score"),
        F.when(F.length(text) > 0, F.round(F.length("summary") / F.length(text), 6)).otherwise(0.0).alias("compression_ratio"),
        F.length(text).alias("original_length"),
    )


def multi_level(docs: DataFrame, levels: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Summaries of summaries: (level, key, summary, importance_score, compression_ratio, original_length).

    Each level is checkpointed, so level n reads the n - 1 summaries instead of computing them again.
    """
    current, out = docs.select(key, F.col(text).alias("text")), None
    for level in range(levels):
        rows = cut_lineage(summaries(current, key=key).drop("sentences").withColumn("level", F.lit(level)))
        out = rows if out is None else out.unionByName(rows)
        current = rows.select(key, F.col("summary").alias("text"))
    return out.select("level", key, "summary", "importance_score", "compression_ratio", "original_length")


def level_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level").agg(
        F.count("*").alias("document_count"), F.round(F.avg("compression_ratio"), 6).alias("avg_compression_ratio"),
        F.round(F.avg("importance_score"), 6).alias("avg_importance_score"), F.sum("original_length").alias("total_original_length"),
        F.sum(F.length("summary")).alias("total_summary_length"),
    )


def compressed_contexts(
    results: DataFrame, target: int, score: str = "score", key: str = "doc_id", query_key: str = "query_id", minimum: int = 100
) -> DataFrame:
    """(query_id, context): results squeezed into `target` characters, each by its share of the score.

    A row's allowance depends on what the rows before it used, so the at most k rows of a query are folded in one row.
    """
    chosen = key_sentences(results.select(key, "text").dropDuplicates([key]), key=key)
    rows = results.join(chosen, key, "left").groupBy(query_key).agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col(score).alias("s"), "sentences", "text"))).alias("d"),
        F.sum(score).alias("total"), F.sum(F.length("text")).alias("chars"),
    )

    def step(acc: Column, d: Column) -> Column:
        share = F.when(F.col("total") > 0, F.floor(d["s"] / F.col("total") * target)).otherwise(F.floor(F.lit(target) / F.size("d")))
        allowed = F.least(F.greatest(F.lit(minimum), share.cast("int")), F.lit(target) - acc["used"])

        def add(limit: Column) -> Column:
            summary = extractive_summary(d["sentences"], limit)
            return T.let(
                F.coalesce(fitted_sentences(d["sentences"], summary, limit), F.lit("")),
                lambda part: F.struct(
                    F.concat(acc["parts"], F.array(F.concat(F.lit("[문서 "), d["rank"].cast("string"), F.lit("]\n"), part))).alias("parts"),
                    (acc["used"] + F.length(part)).alias("used"),
                ),
            )

        return F.when(allowed <= 0, acc).otherwise(T.let(allowed, add))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"))
    squeezed = F.aggregate("d", start, step, lambda acc: T.join(acc["parts"], "\n\n"))
    whole = T.join(F.transform("d", lambda d: d["text"]), "\n\n")
    return rows.select(query_key, F.when(F.col("chars") <= target, whole).otherwise(squeezed).alias("context"))
