"""Context assembly, packing and answer merging.

Retrieval results hold at most k rows per query, so per-query windows and arrays are bounded.  Answers per question are
not: those operators use aggregates that combine before the shuffle instead of sorting a whole group.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import folds
from corpusflow.functions import text as T
from corpusflow.operators import lexical, ranking


def labelled(results: DataFrame, distance: str = "distance", rank: str = "rank") -> DataFrame:
    """Adds `part`: the label line, the cleaned content and a line end."""
    percent = F.round(ranking.relevance_percent(F.col(distance)), 1).cast("string")
    head = F.concat(
        F.lit("[문서 "), F.col(rank).cast("string"), F.lit(": "), F.coalesce("file_name", F.lit(V.UNKNOWN_NAME)),
        F.lit(" (관련도: "), percent, F.lit("%, "), F.coalesce("chunk_id", F.concat(F.lit("chunk_"), F.col(rank) - 1)), F.lit(")]\n"),
    )
    return results.withColumn("part", F.concat(head, T.clean_context(T.strip(F.col("text"))), F.lit("\n")))


def within_budget(parts: DataFrame, budget: int, rank: str = "rank", query_key: str = "query_id") -> DataFrame:
    """Rows up to the first whose running length passes the budget; lengths are not negative, so a running sum decides."""
    order = Window.partitionBy(query_key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("used", F.sum(F.length("part")).over(order)).filter(F.col("used") <= budget)


def contexts(parts: DataFrame, rank: str = "rank", query_key: str = "query_id") -> DataFrame:
    """(query_id, context, documents): the parts of each query in order between two rules."""
    rule = "=" * 50
    rows = parts.groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("o"), "part"))).alias("p"))
    return rows.select(
        query_key,
        F.concat(F.lit("\n" + rule), T.join(F.transform("p", lambda p: p["part"])), F.lit(rule + "\n")).alias("context"),
        F.size("p").alias("documents"),
    )


def prompts(context_rows: DataFrame, questions: DataFrame, template: str, query_key: str = "query_id") -> DataFrame:
    """(query_id, prompt): a table for a model to answer; `template` takes context and question."""
    joined = context_rows.join(questions.select(query_key, F.col("text").alias("question")), query_key)
    return joined.select(query_key, F.format_string(template, "context", "question").alias("prompt"))


def answer_prompts(prompt_rows: DataFrame, model, query_key: str = "query_id") -> DataFrame:
    """(query_id, result, success) from a user callable `model(list of prompts) -> list of texts`, called per Arrow batch."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            try:
                results, good = list(model(list(batch["prompt"]))), True
            except Exception:  # noqa: BLE001 - a failing model is a result row, not a failed job
                results, good = [None] * len(batch), False
            yield pd.DataFrame({query_key: batch[query_key], "result": results, "success": [good and r is not None for r in results]})

    return prompt_rows.select(query_key, "prompt").mapInPandas(run, f"{query_key} bigint, result string, success boolean")


def context_routes(results: DataFrame, threshold: int = V.LARGE_CONTEXT_CHARS, query_key: str = "query_id") -> DataFrame:
    total = F.sum(F.length("text"))
    return results.groupBy(query_key).agg(
        total.alias("total_length"), F.when(total > threshold, "large").otherwise("standard").alias("route")
    )


# --- packing ---------------------------------------------------------------------------------------------------------------------


def _mean_score(mean: str) -> Column:
    """A mean to six places. The mean of two scores of six places ends in a half, which is decided as SQL does: on the product."""
    return F.round(F.col(mean) * 1e6) / 1e6


def pack_results(
    results: DataFrame, strategy: str = "relevance", limit: int = V.MAX_CONTEXT_CHUNK, score: str = "score",
    higher_is_better: bool = True, query_key: str = "query_id",
) -> DataFrame:
    """(query_id, chunk_no, chunk_id, documents, total_length, relevance_score): results packed into context chunks.

    `size` packs in rank order with oversize rows alone, `relevance` packs by score; `split_results` knows all strategies.
    """
    if strategy not in ("size", "relevance"):
        raise ValueError(f"unknown packing strategy: {strategy}")
    keys = [query_key]
    order = F.col("rank") if strategy == "size" else (-F.col(score) if higher_is_better else F.col(score))
    packed = results.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.struct(order.alias("o"), F.col("rank").alias("r"), F.length("text").alias("n"), F.col(score).alias("s")))
        ).alias("d")
    )
    sizes = F.transform("d", lambda d: d["n"])
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    groups = folds.bounded_bins(sizes, limit) if strategy == "size" else folds.pack(sizes, limit, 0)
    numbered = packed.withColumn("total", total).withColumn("g", groups)
    chosen = F.when(
        F.col("total") <= limit, F.array(F.transform("d", lambda _, i: i))
    ).otherwise(F.col("g"))

    def chunk(g: Column, i: Column) -> Column:
        rows = F.transform(g, lambda j: F.get("d", j))
        length = F.aggregate(rows, F.lit(0), lambda a, d: a + d["n"])
        name = F.when(F.col("total") <= limit, "single_chunk").otherwise(
            F.concat(F.when(length > limit, F.lit("large_doc_chunk_" if strategy == "size" else "relevance_chunk_")).otherwise(F.lit(f"{strategy}_chunk_")), i.cast("string"))
        )
        return F.struct(
            name.alias("chunk_id"), F.size(g).alias("documents"), length.alias("total_length"),
            (F.aggregate(rows, F.lit(0.0), lambda a, d: a + d["s"]) / F.size(g)).alias("relevance_score"),
            T.join(F.transform(rows, lambda d: d["r"].cast("string")), ",").alias("ranks"),
        )

    return numbered.select(*keys, F.posexplode(F.transform(chosen, chunk))).select(
        *keys, F.col("pos").alias("chunk_no"), "col.chunk_id", "col.documents", "col.total_length",
        _mean_score("col.relevance_score").alias("relevance_score"), "col.ranks",
    )


def topic_count(documents: int) -> int:
    return max(2, min(5, documents // 3))


def clustered(vectors: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds over a few rows: the cluster of each, and the centres.

    Repeatable: the first centres are rows at equal steps, distances count to nine places, ties go to the first cluster, an
    empty cluster keeps its centre.
    """
    centres = vectors[[i * len(vectors) // k for i in range(k)]]
    labels = np.full(len(vectors), -1)
    for _ in range(rounds):
        distances = (vectors * vectors).sum(1)[:, None] + (centres * centres).sum(1) - 2 * vectors @ centres.T
        now = np.round(distances, 9).argmin(axis=1)
        if (now == labels).all():
            break
        labels = now
        centres = np.stack([vectors[labels == c].mean(axis=0) if (labels == c).any() else centres[c] for c in range(k)])
    return labels, centres


def _tfidf(histograms: list[dict[str, int]], features: int) -> tuple[list[str], np.ndarray]:
    """The most frequent terms of a question's results and the results' unit vectors over them."""
    total, having = Counter(), Counter()
    for h in histograms:
        total.update(h)
        having.update(h.keys())
    terms = sorted(total, key=lambda t: (-total[t], t))[:features]
    idf = np.array([math.log((1 + len(histograms)) / (1 + having[t])) + 1 for t in terms])
    raw = np.array([[h.get(t, 0) for t in terms] for h in histograms], float).reshape(len(histograms), len(terms)) * idf
    norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    return terms, raw / np.where(norm > 0, norm, 1)


def _bins(rows: list[int], sizes: list[int], limit: int, alone: bool) -> list[list[int]]:
    """Rows in order into bins of at most `limit`; `alone` closes the bin behind a row that is larger than that."""
    bins: list[list[int]] = []
    used = 0
    for i in rows:
        if not bins or used + sizes[i] > limit or (alone and used > limit):
            bins.append([])
            used = 0
        bins[-1].append(i)
        used += sizes[i]
    return bins


def _topic_chunks(histograms: list, sizes: list[int], scores: list[float], limit: int, hybrid: bool, features: int) -> list[tuple[str, list[int], list[str]]]:
    """(name, rows, topic terms) of one question's results, which come in order; `scores` are larger for better ones."""
    every = list(range(len(sizes)))

    def by_relevance(rows: list[int]) -> list[tuple[str, list[int], list[str]]]:
        best = sorted(rows, key=lambda i: (-scores[i], i))
        return [(f"relevance_chunk_{n}", part, []) for n, part in enumerate(_bins(best, sizes, limit, False))]

    if sum(sizes) <= limit:
        return [("single_chunk", every, [])]
    if len(sizes) < 3:
        chunks = by_relevance(every)
    else:
        terms, vectors = _tfidf(histograms, features)
        labels, centres = clustered(vectors, topic_count(len(sizes)))
        chunks = []
        for topic in dict.fromkeys(labels.tolist()):
            rows = [i for i in every if labels[i] == topic]
            if sum(sizes[i] for i in rows) > limit:
                parts = enumerate(_bins(rows, sizes, limit, True))
                chunks += [(f"{'large_doc' if sizes[part[0]] > limit else 'size'}_chunk_{n}", part, []) for n, part in parts]
            else:
                own = np.flatnonzero(centres[topic] > 0)  # a topic of fewer than five terms has only those
                best = sorted(own, key=lambda t: (-round(centres[topic][t], 9), terms[t]))[:5]
                chunks.append((f"topic_chunk_{topic}", rows, [terms[t] for t in best]))
    if hybrid:
        chunks = [c for name, rows, words in chunks for c in (by_relevance(rows) if sum(sizes[i] for i in rows) > 0.8 * limit else [(name, rows, words)])]
    return chunks


def pack_by_topic(
    results: DataFrame, limit: int = V.MAX_CONTEXT_CHUNK, score: str = "score", query_key: str = "query_id", hybrid: bool = False,
    higher_is_better: bool = True, features: int = 1000,
) -> DataFrame:
    """Chunks as pack_results gives them, with `topic_terms`: the results of every question clustered among themselves.

    A question has a cluster for every three results, two to five; fewer than three results are packed by relevance. A
    cluster above the limit is packed by size; `hybrid` packs every chunk above 0.8 of the limit again, by relevance. All
    questions are one plan: the results of a question, a bounded list, meet in one task.
    """
    terms = lexical.index_terms(F.col("text"))
    rows = results.select(query_key, "rank", T.run_lengths(terms).alias("h"), F.length("text").alias("n"), F.col(score).cast("double").alias("s"))
    fields = f"{query_key} bigint, chunk_no int, chunk_id string, documents int, total_length int, relevance_score double, ranks string, topic_terms array<string>"

    def chunk(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["rank"])
        sizes, scores = [r["n"] or 0 for r in found], [r["s"] if higher_is_better else -r["s"] for r in found]
        histograms = [{t["item"]: t["n"] for t in r["h"] or []} for r in found]
        out = []
        for number, (name, held, words) in enumerate(_topic_chunks(histograms, sizes, scores, limit, hybrid, features)):
            mean = sum(found[i]["s"] for i in held) / len(held)
            out.append((found[0][query_key], number, name, len(held), sum(sizes[i] for i in held), mean, ",".join(str(found[i]["rank"]) for i in held), words))
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.list_(pa.string())]
        names = [f.split()[0] for f in fields.split(", ")]
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, zip(*out), kinds)})

    return rows.groupBy(query_key).applyInArrow(chunk, fields).withColumn("relevance_score", _mean_score("relevance_score"))


def split_results(results: DataFrame, strategy: str = "relevance", limit: int = V.MAX_CONTEXT_CHUNK, score: str = "score", query_key: str = "query_id", higher_is_better: bool = True) -> DataFrame:
    """The four strategies with one result: `relevance`, `size`, `topic` and `hybrid`; `topic_terms` is empty for the first two."""
    if strategy in ("topic", "hybrid"):
        return pack_by_topic(results, limit, score, query_key, strategy == "hybrid", higher_is_better)
    return pack_results(results, strategy, limit, score, higher_is_better, query_key).withColumn("topic_terms", F.array().cast("array<string>"))


def packing_summary(chunks: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Counts and sizes of a question's chunks, and their distribution: size, documents, relevance and three topic terms of each."""
    terms = F.slice("topic_terms", 1, 3) if "topic_terms" in chunks.columns else F.array().cast("array<string>")
    each = F.struct("chunk_no", F.col("total_length").alias("size"), "documents", F.col("relevance_score").alias("relevance"), terms.alias("topics"))
    return chunks.groupBy(query_key).agg(
        F.count("*").alias("total_chunks"), F.sum("documents").alias("total_documents"), F.sum("total_length").alias("total_length"),
        F.floor(F.avg("total_length")).alias("average_chunk_size"), F.min("total_length").alias("min_chunk_size"),
        F.max("total_length").alias("max_chunk_size"), F.sort_array(F.collect_list(each)).alias("chunk_distribution"),
    )


def chunk_order(relevance: Column, query: Column, text: Column) -> Column:
    """0.7 relevance + 0.3 overlap; the relevance alone for an empty query."""
    return F.when(F.size(T.split_words(query)) == 0, relevance).otherwise(
        relevance * 0.7 + ranking.overlap_score(query, text) * 0.3
    )


def chunk_priority(relevance: Column, query: Column, text: Column, length: Column) -> Column:
    size = F.least(F.lit(1.0), 10000 / F.greatest(length, F.lit(1)))
    return relevance * 0.5 + ranking.overlap_score(query, text) * 0.3 + size * 0.2


# --- answers ------------------------------------------------------------------------------------------------------------------------


def until_good_enough(answers: DataFrame, key: str = "conv_id", order: str = "turn", threshold: float = 0.8, length: int = 100) -> DataFrame:
    """Answers in priority order up to and including the first good one, with `early_stopped` per key.

    The stopping position is a min over the good rows, combined before the shuffle; no group is sorted.
    """
    place = F.struct((-F.col("priority")).alias("p"), F.col(order).alias("o"))
    good = answers.filter(F.col("success") & (F.col("relevance_score") >= threshold) & (F.length("result") >= length))
    stops = good.groupBy(key).agg(F.min(place).alias("_stop"))
    return answers.join(stops, key, "left").filter(F.col("_stop").isNull() | (place <= F.col("_stop"))).drop("_stop")


def successful(answers: DataFrame) -> DataFrame:
    return answers.filter(F.col("success") & (F.coalesce("result", F.lit("")) != ""))


def best_answers(answers: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The successful answer of highest relevance per key, the earliest of equals."""
    best = successful(answers).groupBy(key).agg(
        F.max_by(F.struct(order, "result", "relevance_score"), F.struct("relevance_score", (-F.col(order)).alias("o"))).alias("b")
    )
    return best.select(key, f"b.{order}", "b.result", "b.relevance_score")


def is_duplicate(a: Column, b: Column, threshold: float = 0.7) -> Column:
    x, y = T.word_set(F.lower(a)), T.word_set(F.lower(b))
    return (F.size(x) > 0) & (F.size(y) > 0) & (T.jaccard(x, y) > threshold)


def merge_in_sequence(answers: DataFrame, key: str = "conv_id", order: str = "turn", extra: int = 2) -> DataFrame:
    """(key, answer): the best answer and the first two others that do not repeat it.

    The first two are found by a per-key rank filter, of which every task keeps only two candidates.
    """
    best = best_answers(answers, key, order).select(key, F.col(order).alias("_o"), F.col("result").alias("_best"))
    others = successful(answers).join(best, key).filter(
        (F.col(order) != F.col("_o")) & ~is_duplicate(F.col("_best"), F.col("result"))
    )
    first = others.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= extra)
    added = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "result"))).alias("x"))
    joined = best.join(added, key, "left")
    more = F.concat(F.lit(f"\n\n{V.EXTRA_HEADING}\n"), T.join(F.transform("x", lambda x: x["result"])))
    return joined.select(key, F.concat("_best", F.coalesce(more, F.lit(""))).alias("answer"))


def merge_top(answers: DataFrame, key: str = "conv_id", order: str = "turn", top: int = 3) -> DataFrame:
    """(key, answer, confidence, sources): sentences of the three best answers, each once, under source headings."""
    by_score = Window.partitionBy(key).orderBy(F.col("relevance_score").desc(), order)
    ranked = successful(answers).withColumn("_r", F.row_number().over(by_score)).filter(F.col("_r") <= top)
    gathered = ranked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(order).alias("o"), "result"))).alias("a"))

    def sentences(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, r"\."), T.strip), lambda s: F.length(s) > 20)

    listed = gathered.withColumn("s", F.transform("a", lambda a: F.array_distinct(sentences(T.strip(a["result"])))))

    def fresh(own: Column, i: Column) -> Column:
        earlier = F.flatten(F.slice("s", F.lit(1), i))
        kept = F.array_except(own, earlier)
        return F.when(
            F.size(kept) > 0, F.concat(F.lit("\n[출처 "), (i + 1).cast("string"), F.lit("]\n"), T.join(kept, ". "), F.lit("."))
        )

    parts = F.filter(F.transform("s", fresh), lambda p: p.isNotNull())
    single = F.size("a") == 1
    return listed.select(
        key,
        F.when(single, F.get("a", F.lit(0))["result"]).otherwise(T.join(parts, "\n\n")).alias("answer"),
        F.when(single, 1.0).otherwise(0.8).alias("confidence"),
        T.join(F.transform("a", lambda a: a["o"].cast("string")), ",").alias("sources"),
    )


def processing_counters(answers: DataFrame) -> DataFrame:
    return answers.agg(
        F.count("*").alias("total_chunks_processed"), F.count_if("success").alias("successful_chunks"),
        F.count_if(~F.col("success")).alias("failed_chunks"), F.round(F.sum("processing_time"), 6).alias("total_processing_time"),
        F.round(F.sum("processing_time") / F.count("*"), 6).alias("average_chunk_time"),
    )


# --- records --------------------------------------------------------------------------------------------------------------------------


def source_lines(results: DataFrame, query_key: str = "query_id", limit: int = 3, preview: int = 100) -> DataFrame:
    """(query_id, lines): the first three sources with a preview (a display limit)."""
    share = F.round((1 - F.col("distance")) * 100, 1).cast("string")
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". **"), "file_name", F.lit("**"),
        F.when(F.col("distance") != 0, F.concat(F.lit(" (관련도: "), share, F.lit("%)"))).otherwise(""),
        F.when(F.col("text") != "", F.concat(F.lit("\n   _"), F.left("text", F.lit(preview)), F.lit("..._"))).otherwise(""),
    )
    rows = results.filter(F.col("rank") <= limit).groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"))
    return rows.select(query_key, T.join(F.transform("x", lambda x: x["l"])).alias("lines"))


def search_info(results: DataFrame, queries: DataFrame, context_rows: DataFrame, query_key: str = "query_id", method: str = "tfidf") -> DataFrame:
    """One record per query, also for those without results: counts, context tokens and a status."""
    counts = results.groupBy(query_key).agg(F.count("*").alias("n"))
    joined = queries.select(query_key, F.col("text").alias("original_query")).join(counts, query_key, "left").join(
        context_rows.select(query_key, F.length("context").alias("_c")), query_key, "left"
    )
    return joined.select(
        query_key, "original_query", F.coalesce("n", F.lit(0)).alias("total_documents"), F.lit(method).alias("search_method"),
        F.floor(F.coalesce("_c", F.lit(0)) / V.CHARS_PER_TOKEN).cast("bigint").alias("context_tokens"),
        F.when(F.col("n").isNull(), "no_documents").otherwise("success").alias("status"),
    )
