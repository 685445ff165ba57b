"""Reranking, contexts, packing, summaries and answer merging over retrieval results and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import context, ranking, structure, summary
from corpusflow.plans import sql as S
from corpusflow.plans.clean import _KEPT
from corpusflow.plans.registry import register
from corpusflow.plans.retrieval import _GRAMS, TFIDF, find, passages, with_texts
from corpusflow.session import cut_lineage, table


def results(spark, sf):
    """TF-IDF results with their text and metadata.

    Retrieval runs once: its few rows for each question are kept, and texts are fetched by their ids.
    """
    docs = table(spark, sf, "documents")
    found = cut_lineage(find(spark, sf)(passages(spark, sf), 12).withColumn("score", 1 - F.col("distance")))
    meta = docs.select(
        "doc_id", "text", "source", F.concat("source", F.lit("_"), "lang", F.lit(".txt")).alias("file_name"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit(None).cast("int").alias("page"),
        F.when(F.col("lang") == "en", "pypdf").alias("extraction_method"), F.lit("enhanced_default").alias("processing_method"),
    )
    return with_texts(found, meta)


RES = f"""{TFIDF},
    res AS (SELECT query_id, rank, doc_id, round(1 - similarity, 6) AS distance, 1 - round(1 - similarity, 6) AS score, text, source, source || '_' || lang || '.txt' AS file_name,
        'doc_' || doc_id AS chunk_id, NULL::INT AS page, CASE WHEN lang = 'en' THEN 'pypdf' END AS extraction_method, 'enhanced_default' AS processing_method
        FROM tfidf JOIN documents USING (doc_id))"""


def _quality(t: str) -> str:
    terms = " + ".join(f"contains({t}, {S.quote(w)})::INT" for w in V.PROFESSIONAL_TERMS)
    return f"""least(1.0, 0.5 + 0.2 * {S.match(t, '[' + chr(92) + 'x{3131}-' + chr(92) + 'x{3163}' + chr(92) + 'x{AC00}-' + chr(92) + 'x{D7A3}]')}::INT
        + 0.1 * {S.contains_any(t, V.LIST_MARKS)}::INT + least(0.2, ({terms}) * 0.05))"""


LENGTH = """CASE WHEN len(text) BETWEEN 200 AND 1000 THEN 1.0 WHEN len(text) BETWEEN 100 AND 199 OR len(text) BETWEEN 1001 AND 1500 THEN 0.8
    WHEN len(text) BETWEEN 50 AND 99 OR len(text) BETWEEN 1501 AND 2000 THEN 0.6 ELSE 0.3 END"""
META = """least(1.0, 0.5 + CASE WHEN len(file_name) > 5 AND NOT starts_with(file_name, 'temp_') THEN 0.2 ELSE 0 END + 0.1 + 0.1
    + CASE WHEN extraction_method = 'pypdf' THEN 0.1 ELSE 0 END)"""
RERANK = f"""{RES},
    rr AS (SELECT *, round({_quality('text')}::DOUBLE, 6) AS document_quality, round({META}::DOUBLE, 6) AS metadata_quality,
        round((greatest(0, least(1, (2.0 - distance) / 2.0)) * 0.7 + {_quality('text')} * 0.1 + {LENGTH} * 0.1 + {META} * 0.1)::DOUBLE, 8) AS final_score FROM res),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS new_rank FROM rr)"""


@register("document_quality_scores", f"SELECT doc_id, round({_quality('text')}::DOUBLE, 6) AS quality, {LENGTH}::DOUBLE AS length_score FROM documents")
def document_quality_scores(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.round(ranking.document_quality(F.col("text")), 6).alias("quality"), ranking.length_score(F.length("text")).alias("length_score")
    )


@register("results_reranked", f"WITH {RERANK} SELECT query_id, new_rank, doc_id, document_quality, metadata_quality, final_score FROM rk")
def results_reranked(spark, sf):
    return ranking.rerank(results(spark, sf)).select("query_id", "new_rank", "doc_id", "document_quality", "metadata_quality", "final_score")


@register("source_table", f"""WITH {RERANK} SELECT query_id, new_rank AS index, source, file_name, 'N/A' AS page, chunk_id, round(greatest(0, least(100, (2.0 - distance) * 50)), 6) AS relevance_score,
    len(text) AS content_length, coalesce(extraction_method, '{V.UNKNOWN_NAME}') AS extraction_method, processing_method, document_quality, metadata_quality FROM rk""")
def source_table(spark, sf):
    return ranking.source_table(ranking.rerank(results(spark, sf)))


def _reference_sql(relevance: str) -> str:
    return f"string_agg('- [출처 ' || rank || '] ' || file_name || ' (' || 'p.' || rank || ', ' || chunk_id || ')', chr(10) ORDER BY rank)"


@register("reference_blocks", f"""WITH {RES} SELECT query_id, {_reference_sql('')} AS "references" FROM res GROUP BY query_id""")
def reference_blocks(spark, sf):
    rows = results(spark, sf).select(
        "query_id", F.col("rank").alias("index"), "file_name", "source", F.lit(0.0).alias("relevance_score"), F.col("rank").cast("string").alias("page"), "chunk_id"
    )
    return structure.reference_block(rows)


# --- contexts -------------------------------------------------------------------------------------------------------------------------

_CLEAN = f"CASE WHEN len({_KEPT}) > 0 THEN {S.join(_KEPT)} ELSE {S.strip(S.sub('text', r'\s+', ' '))} END"
PARTS = f"""{RES},
    trimmed AS (SELECT * REPLACE ({S.strip('text')} AS text) FROM res),
    parts AS (SELECT *, '[문서 ' || rank || ': ' || file_name || ' (관련도: ' || round(greatest(0, least(100, (2.0 - distance) * 50)), 1) || '%, ' || chunk_id || ')]' || chr(10) || {_CLEAN} || chr(10) AS part FROM trimmed),
    fit AS (SELECT * FROM (SELECT *, sum(len(part)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM parts) WHERE used <= 8000),
    ctx AS (SELECT query_id, chr(10) || repeat('=', 50) || string_agg(part, chr(10) ORDER BY rank) || repeat('=', 50) || chr(10) AS context, count(*) AS documents FROM fit GROUP BY query_id)"""
BUDGET = 8000


def _fit(spark, sf):
    return context.within_budget(context.labelled(results(spark, sf)), BUDGET)


@register("context_parts", f"WITH {PARTS} SELECT query_id, rank, part, used::BIGINT AS used FROM fit")
def context_parts(spark, sf):
    return _fit(spark, sf).select("query_id", "rank", "part", "used")


@register("contexts", f"WITH {PARTS} SELECT * FROM ctx")
def contexts(spark, sf):
    return context.contexts(_fit(spark, sf))


PROMPT = "[context]\n%s\n[question]\n%s\n"


@register("prompts", f"""WITH {PARTS} SELECT query_id, '[context]' || chr(10) || context || chr(10) || '[question]' || chr(10) || b.text || chr(10) AS prompt FROM ctx JOIN benchmark b ON item_id = query_id""")
def prompts(spark, sf):
    return context.prompts(context.contexts(_fit(spark, sf)), passages(spark, sf), PROMPT)


@register("context_routes", f"WITH {RES} SELECT query_id, sum(len(text))::BIGINT AS total_length, CASE WHEN sum(len(text)) > 50000 THEN 'large' ELSE 'standard' END AS route FROM res GROUP BY query_id")
def context_routes(spark, sf):
    return context.context_routes(results(spark, sf))


@register("source_lines", f"""WITH {RES} SELECT query_id, string_agg(rank || '. **' || file_name || '**' || CASE WHEN distance <> 0 THEN ' (관련도: ' || round((1 - distance) * 100, 1) || '%)' ELSE '' END
    || CASE WHEN text <> '' THEN chr(10) || '   _' || left(text, 100) || '..._' ELSE '' END, chr(10) ORDER BY rank) AS lines FROM res WHERE rank <= 3 GROUP BY query_id""")
def source_lines(spark, sf):
    return context.source_lines(results(spark, sf))


@register("search_records", f"""WITH {PARTS}, n AS (SELECT query_id, count(*) AS n FROM res GROUP BY query_id)
    SELECT item_id AS query_id, text AS original_query, coalesce(n, 0) AS total_documents, 'tfidf' AS search_method, (coalesce(len(context), 0) // 4)::BIGINT AS context_tokens,
        CASE WHEN n IS NULL THEN 'no_documents' ELSE 'success' END AS status FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN ctx ON ctx.query_id = item_id""")
def search_records(spark, sf):
    rows = results(spark, sf)
    return context.search_info(rows, passages(spark, sf), context.contexts(context.within_budget(context.labelled(rows), BUDGET)))


# --- packing ------------------------------------------------------------------------------------------------------------------------------

LIMIT = 5000


def _packed(order: str, large: str, name: str, alone: bool) -> str:
    opens = f"(w.used + x.n > {LIMIT}" + (f" OR x.n > {LIMIT} OR w.used > {LIMIT})" if alone else ")")
    return f"""
    WITH RECURSIVE {RES},
    o AS MATERIALIZED (SELECT query_id, rank, score, len(text) AS n, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS i, sum(len(text)) OVER (PARTITION BY query_id) AS total FROM res),
    walk AS (SELECT query_id, 1::BIGINT AS i, 0 AS g, n AS used FROM o WHERE i = 1
        UNION ALL SELECT w.query_id, w.i + 1, CASE WHEN {opens} THEN w.g + 1 ELSE w.g END, CASE WHEN {opens} THEN x.n ELSE w.used + x.n END
        FROM walk w JOIN o x ON x.query_id = w.query_id AND x.i = w.i + 1),
    pk AS (SELECT query_id, CASE WHEN total <= {LIMIT} THEN 0 ELSE g END AS chunk_no, any_value(total) AS total, count(*) AS documents, sum(n)::BIGINT AS total_length,
        round(avg(score), 6) AS relevance_score, string_agg(rank::VARCHAR, ',' ORDER BY i) AS ranks FROM walk JOIN o USING (query_id, i) GROUP BY query_id, CASE WHEN total <= {LIMIT} THEN 0 ELSE g END),
    packed AS (SELECT query_id, chunk_no, CASE WHEN total <= {LIMIT} THEN 'single_chunk' WHEN total_length > {LIMIT} THEN '{large}' || chunk_no ELSE '{name}' || chunk_no END AS chunk_id,
        documents, total_length, relevance_score, ranks FROM pk)"""


@register("packed_by_size", _packed("rank", "large_doc_chunk_", "size_chunk_", True) + " SELECT * FROM packed")
def packed_by_size(spark, sf):
    return context.pack_results(results(spark, sf), "size", LIMIT)


@register("packed_by_relevance", _packed("score DESC, rank", "relevance_chunk_", "relevance_chunk_", False) + " SELECT * FROM packed")
def packed_by_relevance(spark, sf):
    return context.pack_results(results(spark, sf), "relevance", LIMIT)


TOPIC_LIMIT = 9000


def _clustered(rounds: int = 10) -> str:
    """Lloyd's rounds over the results of every question, one pair of steps for each round."""
    steps = []
    for r in range(rounds):
        steps.append(f"""
    a{r + 1} AS MATERIALIZED (SELECT query_id, i, c FROM (SELECT query_id, i, c, row_number() OVER (PARTITION BY query_id, i ORDER BY round(xx + cc - 2 * coalesce(dot, 0), 9), c) AS o
        FROM (SELECT tr.query_id, tr.i, cl.c, coalesce(xx, 0) AS xx, coalesce(cc, 0) AS cc FROM tr JOIN cl USING (query_id) LEFT JOIN (SELECT query_id, i, sum(w * w) AS xx FROM x GROUP BY ALL) USING (query_id, i)
            LEFT JOIN (SELECT query_id, c, sum(w * w) AS cc FROM c{r} GROUP BY ALL) USING (query_id, c))
        LEFT JOIN (SELECT x.query_id, x.i, c, sum(x.w * c{r}.w) AS dot FROM x JOIN c{r} USING (query_id, term) GROUP BY ALL) USING (query_id, i, c)) WHERE o = 1),
    c{r + 1} AS MATERIALIZED (SELECT query_id, c, term, sum(w) / any_value(members) AS w FROM a{r + 1} JOIN (SELECT query_id, c, count(*) AS members FROM a{r + 1} GROUP BY ALL) USING (query_id, c) JOIN x USING (query_id, i) GROUP BY query_id, c, term
        UNION ALL SELECT query_id, c, term, w FROM c{r} WHERE (query_id, c) NOT IN (SELECT (query_id, c) FROM a{r + 1}))""")
    return ",".join(steps)


TOPICS = f"""
    tr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS m, sum(n) OVER (PARTITION BY query_id) AS total
        FROM (SELECT query_id, rank, score, len(text) AS n, {S.tokens('text')} AS t FROM res)),
    ks AS (SELECT DISTINCT query_id, m, greatest(2, least(5, m // 3)) AS k FROM tr WHERE total > {TOPIC_LIMIT} AND m >= 3),
    cl AS (SELECT query_id, c FROM ks, range(5) r(c) WHERE c < k),
    tp AS MATERIALIZED (SELECT query_id, i, term, count(*) AS tf FROM (SELECT query_id, i, unnest({_GRAMS}) AS term FROM tr SEMI JOIN ks USING (query_id)) GROUP BY ALL),
    tv AS (SELECT query_id, term, count(*) AS df FROM tp GROUP BY query_id, term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, term) <= 1000),
    tw AS (SELECT query_id, i, term, tf * (ln((1.0 + m) / (1.0 + df)) + 1.0) AS w FROM tp JOIN tv USING (query_id, term) JOIN ks USING (query_id)),
    x AS MATERIALIZED (SELECT query_id, i, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, i)) AS w FROM tw),
    c0 AS MATERIALIZED (SELECT query_id, c, term, w FROM cl JOIN ks USING (query_id) JOIN x USING (query_id) WHERE i = (c * m) // k),
    {_clustered()}"""


def _by_topic(hybrid: bool) -> str:
    again = f"glen > 0.8 * {TOPIC_LIMIT} AND mode <> 'single'" if hybrid else "false"
    return f"""
    WITH RECURSIVE {RES}, {TOPICS},
    g AS (SELECT tr.query_id, tr.i, rank, score, n, coalesce(c, 0) AS c, CASE WHEN total <= {TOPIC_LIMIT} THEN 'single' WHEN m < 3 THEN 'relevance' ELSE 'topic' END AS kind FROM tr LEFT JOIN a10 USING (query_id, i)),
    g2 AS (SELECT *, min(i) OVER (PARTITION BY query_id, c) AS first, CASE WHEN kind = 'topic' AND sum(n) OVER (PARTITION BY query_id, c) > {TOPIC_LIMIT} THEN 'size' ELSE kind END AS mode FROM g),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY CASE WHEN mode = 'relevance' THEN -score ELSE 0 END, i) AS j FROM g2),
    walk AS (SELECT query_id, c, j, 0 AS bin, n AS used FROM o WHERE j = 1
        UNION ALL SELECT w.query_id, w.c, w.j + 1, CASE WHEN {{opens}} THEN w.bin + 1 ELSE w.bin END, CASE WHEN {{opens}} THEN y.n ELSE w.used + y.n END
        FROM walk w JOIN o y ON y.query_id = w.query_id AND y.c = w.c AND y.j = w.j + 1),
    b AS (SELECT o.*, bin, sum(n) OVER (PARTITION BY query_id, c, bin) AS glen, max(n) OVER (PARTITION BY query_id, c, bin) AS most FROM o JOIN walk USING (query_id, c, j)),
    b2 AS MATERIALIZED (SELECT *, {again} AS again, row_number() OVER (PARTITION BY query_id, c, bin ORDER BY CASE WHEN {again} THEN -score ELSE 0 END, CASE WHEN {again} THEN i ELSE j END) AS j2 FROM b),
    walk2 AS (SELECT query_id, c, bin, j2, 0 AS bin2, n AS used FROM b2 WHERE j2 = 1
        UNION ALL SELECT w.query_id, w.c, w.bin, w.j2 + 1, CASE WHEN y.again AND w.used + y.n > {TOPIC_LIMIT} THEN w.bin2 + 1 ELSE w.bin2 END, CASE WHEN y.again AND w.used + y.n > {TOPIC_LIMIT} THEN y.n ELSE w.used + y.n END
        FROM walk2 w JOIN b2 y ON y.query_id = w.query_id AND y.c = w.c AND y.bin = w.bin AND y.j2 = w.j2 + 1),
    words AS (SELECT query_id, c, list(term ORDER BY o) AS terms FROM (SELECT query_id, c, term, row_number() OVER (PARTITION BY query_id, c ORDER BY round(w, 9) DESC, term) AS o FROM c10) WHERE o <= 5 GROUP BY ALL),
    chunks AS (SELECT query_id, c, bin, bin2, any_value(first) AS first, any_value(mode) AS mode, any_value(again) AS again, any_value(most) AS most, count(*)::INT AS documents, sum(n)::INT AS total_length,
        round(avg(score), 6) AS relevance_score, string_agg(rank::VARCHAR, ',' ORDER BY j2) AS ranks FROM b2 JOIN walk2 USING (query_id, c, bin, j2) GROUP BY query_id, c, bin, bin2),
    packed AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY first, bin, bin2) - 1)::INT AS chunk_no,
        CASE WHEN again THEN 'relevance_chunk_' || bin2 WHEN mode = 'single' THEN 'single_chunk' WHEN mode = 'relevance' THEN 'relevance_chunk_' || bin WHEN mode = 'topic' THEN 'topic_chunk_' || c
            WHEN most > {TOPIC_LIMIT} THEN 'large_doc_chunk_' || bin ELSE 'size_chunk_' || bin END AS chunk_id,
        documents, total_length, relevance_score, ranks, CASE WHEN mode = 'topic' AND NOT again THEN terms ELSE [] END AS topic_terms
        FROM chunks LEFT JOIN words USING (query_id, c))""".replace("{opens}", f"(y.mode IN ('size', 'relevance') AND (w.used + y.n > {TOPIC_LIMIT} OR (y.mode = 'size' AND w.used > {TOPIC_LIMIT})))")


@register("packed_by_topic", _by_topic(False) + " SELECT * FROM packed")
def packed_by_topic(spark, sf):
    return context.split_results(results(spark, sf), "topic", TOPIC_LIMIT)


@register("packed_hybrid", _by_topic(True) + " SELECT * FROM packed")
def packed_hybrid(spark, sf):
    return context.split_results(results(spark, sf), "hybrid", TOPIC_LIMIT)


@register("packing_summary", _by_topic(False) + """
    SELECT query_id, count(*) AS total_chunks, sum(documents)::BIGINT AS total_documents, sum(total_length)::BIGINT AS total_length, floor(avg(total_length))::BIGINT AS average_chunk_size,
        min(total_length) AS min_chunk_size, max(total_length) AS max_chunk_size,
        string_agg(chunk_no || ':' || total_length || ':' || documents || ':' || array_to_string(topic_terms[1:3], '+'), ';' ORDER BY chunk_no) AS distribution FROM packed GROUP BY query_id""")
def packing_summary(spark, sf):
    """Counts, sizes, and the distribution of the chunks written out as one text."""
    each = F.transform("chunk_distribution", lambda c: F.concat_ws(":", c["chunk_no"].cast("string"), c["size"].cast("string"), c["documents"].cast("string"), F.array_join(c["topics"], "+")))
    return context.packing_summary(packed_by_topic(spark, sf)).withColumn("distribution", F.array_join(each, ";")).drop("chunk_distribution")


@register("topic_keywords", _by_topic(False) + " SELECT query_id, chunk_id, unnest(topic_terms) AS term, generate_subscripts(topic_terms, 1)::INT AS rank FROM packed")
def topic_keywords(spark, sf):
    """The five terms of every topic among a question's results."""
    rows = packed_by_topic(spark, sf).select("query_id", "chunk_id", F.posexplode("topic_terms").alias("pos", "term"))
    return rows.select("query_id", "chunk_id", "term", (F.col("pos") + 1).alias("rank"))


_OVERLAP = "(len(list_intersect(list_distinct({q}), list_distinct({t}))) / len(list_distinct({q})))"


def overlap(q: str, t: str) -> str:
    q, t = S.words(f"lower({q})"), S.words(f"lower({t})")
    return f"CASE WHEN len({q}) = 0 THEN 0.0 ELSE {_OVERLAP.format(q=q, t=t)} END"


@register("chunk_order", f"""WITH {RES} SELECT query_id, doc_id, round((score * 0.7 + ({overlap('b.text', 'res.text')}) * 0.3)::DOUBLE, 8) AS combined,
    round((score * 0.5 + ({overlap('b.text', 'res.text')}) * 0.3 + least(1.0, 10000 / greatest(len(res.text), 1)) * 0.2)::DOUBLE, 8) AS priority FROM res JOIN benchmark b ON item_id = query_id""")
def chunk_order(spark, sf):
    rows = results(spark, sf).join(passages(spark, sf).select("query_id", F.col("text").alias("question")), "query_id")
    score, question, text = F.col("score"), F.col("question"), F.col("text")
    return rows.select(
        "query_id", "doc_id", F.round(context.chunk_order(score, question, text), 8).alias("combined"),
        F.round(context.chunk_priority(score, question, text, F.length(text)), 8).alias("priority"),
    )


# --- summaries ----------------------------------------------------------------------------------------------------------------------------

SPACED = f"string_split({S.sub(S.strip('text'), r'([.!?])\s+', '$1' + chr(1))}, chr(1))"
KEYS = f"""
    sl AS (SELECT doc_id, {SPACED} AS s FROM documents WHERE {S.strip('text')} <> ''),
    st AS (SELECT doc_id, i, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, i, len(s) AS n, unnest({S.tokens('s[i]')}) AS term FROM sl, range(1, len(s) + 1) r(i) WHERE len(s) > 5) GROUP BY doc_id, i, term),
    sw AS (SELECT doc_id, i, tf * (ln((n + 1.0) / (count(*) OVER (PARTITION BY doc_id, term) + 1.0)) + 1.0) AS w FROM st),
    ss AS (SELECT doc_id, i, round(0.7 * sum(w) / sqrt(sum(w * w)), 6) AS score FROM sw GROUP BY doc_id, i),
    sr AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM ss),
    ks AS (SELECT doc_id, list(s[i] ORDER BY i) AS ks FROM sr JOIN sl USING (doc_id) WHERE r <= 5 GROUP BY doc_id
        UNION ALL SELECT doc_id, s FROM sl WHERE len(s) <= 5)"""
SUMMARY = f"""{KEYS},
    kk AS (SELECT doc_id, j, ks[j] AS s, len(ks[j]) AS n FROM ks, range(1, len(ks) + 1) r(j)),
    ku AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY j) AS used FROM kk),
    kp AS (SELECT *, min(CASE WHEN used > 500 THEN j END) OVER (PARTITION BY doc_id) AS over FROM ku),
    sm AS (SELECT doc_id, coalesce(string_agg(CASE WHEN over IS NULL OR j < over THEN s ELSE regexp_replace(left(s, (500 - (used - n))::INT), ' [^ ]*$', '') || '...' END, ' ' ORDER BY j)
        FILTER (over IS NULL OR j < over OR (j = over AND 500 - (used - n) > 50)), '') AS summary FROM kp GROUP BY doc_id)"""


@register("key_sentences", f"WITH {KEYS} SELECT doc_id, array_to_string(ks, '|') AS sentences FROM ks")
def key_sentences(spark, sf):
    return summary.key_sentences(table(spark, sf, "documents")).select("doc_id", T.join("sentences", "|").alias("sentences"))


@register("key_sentences_for_query")
def key_sentences_for_query(spark, sf):
    docs = table(spark, sf, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    return summary.key_sentences(docs, query="title").select("doc_id", T.join("sentences", "|").alias("sentences"))


_INFO = " + ".join(S.count("text", p) for p in V.INFO_PATTERNS)
_IMPORTANCE = f"CASE WHEN {S.strip('text')} = '' THEN 0 ELSE least(1.0, len(text) / 1000) * 0.3 + least(1.0, ({_INFO}) / 10) * 0.2 END"


@register("document_summaries", f"""WITH {SUMMARY} SELECT doc_id, coalesce(summary, '') AS summary, round(({_IMPORTANCE})::DOUBLE, 6) AS importance_score,
    round(CASE WHEN len(text) > 0 THEN len(coalesce(summary, '')) / len(text) ELSE 0 END, 6) AS compression_ratio FROM documents LEFT JOIN sm USING (doc_id)""")
def document_summaries(spark, sf):
    return summary.summaries(table(spark, sf, "documents")).select("doc_id", "summary", "importance_score", "compression_ratio")


@register("fitted_summaries")
def fitted_summaries(spark, sf):
    rows = summary.summaries(table(spark, sf, "documents"))
    return rows.select("doc_id", summary.fitted_sentences(F.col("sentences"), F.col("summary"), 300).alias("fitted"))


@register("importance_scores", f"""SELECT doc_id, round((({_IMPORTANCE}) + 0.5 * ({overlap("string_split(text, chr(10))[1]", 'text')}))::DOUBLE, 6) AS importance FROM documents""")
def importance_scores(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(summary.importance(F.col("text"), F.substring_index("text", "\n", 1)), 6).alias("importance"))


@register("summary_lengths", "SELECT doc_id, CASE WHEN n_chars // 4 <= 0 THEN 500 ELSE greatest(150, least(500, n_chars // 4)) END AS target FROM documents")
def summary_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", summary.summary_length(F.floor(F.col("n_chars") / 4)).alias("target"))


@register("multi_level_statistics")
def multi_level_statistics(spark, sf):
    return summary.level_statistics(summary.multi_level(table(spark, sf, "documents")))


@register("compressed_contexts")
def compressed_contexts(spark, sf):
    return summary.compressed_contexts(results(spark, sf), 2000)


# --- answers --------------------------------------------------------------------------------------------------------------------------------


def answers(spark, sf):
    """Assistant turns as answers to the first user turn of their conversation."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    rows = turns.filter(F.col("role") == "assistant").join(asked, "conv_id", "left")
    length = F.length("text")
    return rows.select(
        "conv_id", "turn", F.coalesce("question", F.lit("")).alias("question"), F.col("text").alias("result"),
        F.round(length / (length + 200), 6).alias("relevance_score"), (length > 20).alias("success"), (length / 1000).alias("processing_time"),
    ).withColumn("priority", F.round(context.chunk_priority(F.col("relevance_score"), F.col("question"), F.col("result"), F.length("result")), 6))


ANSWERS = f"""
    qs AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    an0 AS (SELECT conv_id, turn, coalesce(question, '') AS question, text AS result, round(len(text) / (len(text) + 200), 6) AS relevance_score, len(text) > 20 AS success, len(text) / 1000 AS processing_time
        FROM conversations LEFT JOIN qs USING (conv_id) WHERE role = 'assistant'),
    an AS (SELECT *, round((relevance_score * 0.5 + ({overlap('question', 'result')}) * 0.3 + least(1.0, 10000 / greatest(len(result), 1)) * 0.2)::DOUBLE, 6) AS priority FROM an0)"""


@register("answer_priorities", f"WITH {ANSWERS} SELECT conv_id, turn, priority FROM an")
def answer_priorities(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", "priority")


@register("answers_until_good", f"""WITH {ANSWERS} SELECT conv_id, turn FROM (SELECT *, coalesce(sum((success AND relevance_score >= 0.8 AND len(result) >= 100)::INT) OVER
    (PARTITION BY conv_id ORDER BY priority DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM an) WHERE stops = 0""")
def answers_until_good(spark, sf):
    return context.until_good_enough(answers(spark, sf)).select("conv_id", "turn")


BEST = "ok AS (SELECT * FROM an WHERE success AND result <> ''), best AS (SELECT conv_id, turn, result, relevance_score FROM ok QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY relevance_score DESC, turn) = 1)"


@register("best_answers", f"WITH {ANSWERS}, {BEST} SELECT conv_id, turn, result, relevance_score FROM best")
def best_answers(spark, sf):
    return context.best_answers(answers(spark, sf))


def _jac(a: str, b: str) -> str:
    a, b = f"list_distinct({S.words(f'lower({a})')})", f"list_distinct({S.words(f'lower({b})')})"
    return f"(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) > 0.7)"


@register("answers_merged_in_sequence", f"""WITH {ANSWERS}, {BEST},
    ot AS (SELECT ok.conv_id, ok.turn, ok.result, row_number() OVER (PARTITION BY ok.conv_id ORDER BY ok.turn) AS n FROM ok JOIN best ON best.conv_id = ok.conv_id AND best.turn <> ok.turn WHERE NOT {_jac('best.result', 'ok.result')}),
    ex AS (SELECT conv_id, string_agg(result, chr(10) ORDER BY n) AS x FROM ot WHERE n <= 2 GROUP BY conv_id)
    SELECT conv_id, result || coalesce(chr(10)||chr(10) || '{V.EXTRA_HEADING}' || chr(10) || x, '') AS answer FROM best LEFT JOIN ex USING (conv_id)""")
def answers_merged_in_sequence(spark, sf):
    return context.merge_in_sequence(answers(spark, sf))


@register("answers_merged_by_sentence", f"""WITH {ANSWERS}, {BEST},
    tp AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY relevance_score DESC, turn) AS r, count(*) OVER (PARTITION BY conv_id) AS c FROM ok),
    t3 AS (SELECT * FROM tp WHERE r <= 3),
    se AS (SELECT conv_id, r, i, {S.strip('p[i]')} AS s FROM (SELECT conv_id, r, string_split({S.strip('result')}, '.') AS p FROM t3), range(1, len(p) + 1) q(i)),
    sf AS (SELECT * FROM se WHERE len(s) > 20 QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY r, i) = 1),
    pa AS (SELECT conv_id, r, chr(10) || '[출처 ' || r || ']' || chr(10) || string_agg(s, '. ' ORDER BY i) || '.' AS p FROM sf GROUP BY conv_id, r),
    al AS (SELECT conv_id, string_agg(p, chr(10)||chr(10) ORDER BY r) AS m FROM pa GROUP BY conv_id),
    so AS (SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY r) AS sources, least(any_value(c), 3) AS c, any_value(result) FILTER (r = 1) AS one FROM t3 GROUP BY conv_id)
    SELECT conv_id, CASE WHEN c = 1 THEN one ELSE coalesce(m, '') END AS answer, CASE WHEN c = 1 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence, sources FROM so LEFT JOIN al USING (conv_id)""")
def answers_merged_by_sentence(spark, sf):
    return context.merge_top(answers(spark, sf))


@register("processing_counters", f"""WITH {ANSWERS} SELECT count(*) AS total_chunks_processed, count(*) FILTER (success) AS successful_chunks, count(*) FILTER (NOT success) AS failed_chunks,
    round(sum(processing_time), 6) AS total_processing_time, round(sum(processing_time) / count(*), 6) AS average_chunk_time FROM an""")
def processing_counters(spark, sf):
    return context.processing_counters(answers(spark, sf))
