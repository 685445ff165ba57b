"""Chunking over `documents`, whose paragraphs are separated by single newlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import sentences as L
from corpusflow.functions import text as T
from corpusflow.operators import chunking
from corpusflow.plans import sql as S
from corpusflow.plans.registry import register
from corpusflow.plans.structure import SENTENCES, _mid, image_rows, IMAGES
from corpusflow.session import table

NL = "\n"


def docs(spark, sf):
    return table(spark, sf, "documents")


def _rows(listed, name: str = "text"):
    return listed.select("doc_id", F.posexplode("chunks").alias("chunk_no", name))


SLIDING = f"""
    sl AS (SELECT doc_id, ((s - 1) // {V.CHUNK_SIZE - V.CHUNK_OVERLAP})::INT AS chunk_index, substr(text, s::INT, {V.CHUNK_SIZE}) AS text
           FROM documents, generate_series(1, greatest(len(text) - {V.CHUNK_OVERLAP}, 1), {V.CHUNK_SIZE - V.CHUNK_OVERLAP}) g(s) WHERE text <> '')"""


@register("sliding_chunks", f"WITH {SLIDING} SELECT * FROM sl")
def sliding_chunks(spark, sf):
    return chunking.sliding_chunks(docs(spark, sf))


@register("recursive_chunks")
def recursive_chunks(spark, sf):
    return _rows(chunking.recursive_chunks(docs(spark, sf)))


@register("recursive_markdown_chunks")
def recursive_markdown_chunks(spark, sf):
    return _rows(chunking.recursive_chunks(docs(spark, sf), separators=V.MARKDOWN_SEPARATORS))


@register("recursive_plain_chunks")
def recursive_plain_chunks(spark, sf):
    return _rows(chunking.recursive_chunks(docs(spark, sf), separators=V.PLAIN_SEPARATORS))


@register("default_chunks")
def default_chunks(spark, sf):
    return chunking.chunk_documents(docs(spark, sf))


@register("markdown_chunks")
def markdown_chunks(spark, sf):
    return chunking.chunk_documents(docs(spark, sf), "md")


def _merge(short: int, limit: float, keep: int) -> str:
    """Lines as chunks, folded with a recursive walk that carries the open chunk of every document."""
    return f"""
    WITH RECURSIVE ls AS (SELECT doc_id, {S.lines('text')} AS l FROM documents),
    it AS MATERIALIZED (SELECT doc_id, i, l[i] AS raw, {S.strip('l[i]')} AS c, len({S.strip('l[i]')}) AS n FROM ls, range(1, len(l) + 1) r(i)),
    walk AS (
        SELECT doc_id, 1::BIGINT AS i, CASE WHEN n >= {keep} THEN 1 ELSE 0 END AS g, CASE WHEN n >= {keep} THEN len(raw) ELSE 0 END AS used,
               n >= {keep} AS kept FROM it WHERE i = 1
        UNION ALL
        SELECT w.doc_id, w.i + 1,
            CASE WHEN x.n < {short} AND w.g > 0 AND w.used + 2 + x.n <= {limit} THEN w.g WHEN x.n >= {keep} THEN w.g + 1 ELSE w.g END,
            CASE WHEN x.n < {short} AND w.g > 0 AND w.used + 2 + x.n <= {limit} THEN w.used + 2 + x.n WHEN x.n >= {keep} THEN len(x.raw) ELSE w.used END,
            (x.n < {short} AND w.g > 0 AND w.used + 2 + x.n <= {limit}) OR x.n >= {keep}
        FROM walk w JOIN it x ON x.doc_id = w.doc_id AND x.i = w.i + 1),
    parts AS (SELECT doc_id, g, i, CASE WHEN i = min(i) OVER (PARTITION BY doc_id, g) THEN raw ELSE c END AS t FROM walk JOIN it USING (doc_id, i) WHERE kept)
    SELECT doc_id, (g - 1)::INT AS chunk_no, string_agg(t, chr(10)||chr(10) ORDER BY i) AS text FROM parts GROUP BY doc_id, g"""


@register("short_chunks_merged", _merge(500, 600 * 1.5, 100))
def short_chunks_merged(spark, sf):
    listed = docs(spark, sf).select("doc_id", T.lines(F.col("text")).alias("chunks"))
    return _rows(chunking.merge_short_chunks(listed, 600))


@register("short_markdown_chunks_merged", _merge(200, 400 * 1.3, 50))
def short_markdown_chunks_merged(spark, sf):
    listed = docs(spark, sf).select("doc_id", T.lines(F.col("text")).alias("chunks"))
    return _rows(chunking.merge_short_chunks(listed, 400, 200, 1.3, 50))


PARAGRAPHS = f"""
    ps AS (SELECT doc_id, list_filter(list_transform({S.lines('text')}, lambda p: {S.strip('p')}), lambda p: p <> '') AS l FROM documents),
    it AS MATERIALIZED (SELECT doc_id, i, l[i] AS t, len(l[i]) AS n FROM ps, range(1, len(l) + 1) r(i))"""


def _pack(opens: str, items: str = PARAGRAPHS, gap: int = 2, order: str = "chr(10)||chr(10)") -> str:
    """`opens` sees w.used (open bin) and x.n (next item)."""
    return f"""
    WITH RECURSIVE {items},
    walk AS (SELECT doc_id, 1::BIGINT AS i, 1 AS g, n AS used FROM it WHERE i = 1
        UNION ALL SELECT w.doc_id, w.i + 1, CASE WHEN {opens} THEN w.g + 1 ELSE w.g END, CASE WHEN {opens} THEN x.n ELSE w.used + {gap} + x.n END
        FROM walk w JOIN it x ON x.doc_id = w.doc_id AND x.i = w.i + 1),
    bins AS (SELECT doc_id, (g - 1)::INT AS chunk_no, string_agg(t, {order} ORDER BY i) AS text FROM walk JOIN it USING (doc_id, i) GROUP BY doc_id, g)"""


@register("packed_paragraphs", _pack("w.used + 2 + x.n > 1200 AND w.used >= 300") + " SELECT * FROM bins")
def packed_paragraphs(spark, sf):
    return _rows(chunking.packed_paragraphs(docs(spark, sf), separator=NL))


RAW_LINES = f"""
    ps AS (SELECT doc_id, {S.lines('text')} AS l FROM documents WHERE len(text) > 3000),
    it AS MATERIALIZED (SELECT doc_id, i, l[i] AS t, len(l[i]) AS n FROM ps, range(1, len(l) + 1) r(i))"""


@register("paragraph_blocks", _pack("w.used + 2 + x.n > 3000", RAW_LINES) + """
    SELECT * FROM bins WHERE text <> '' UNION ALL SELECT doc_id, 0, text FROM documents WHERE len(text) <= 3000""")
def paragraph_blocks(spark, sf):
    return _rows(chunking.blocks(docs(spark, sf), separator=NL))


_SPLIT = f"regexp_split_to_array({S.strip('text')}, '{S.re2(chr(92) + 'n')}')"
BOUNDARY = f"""
    WITH RECURSIVE ps AS (SELECT doc_id, {_SPLIT} AS l FROM documents),
    it AS MATERIALIZED (SELECT doc_id, i, l[i] AS t, len(l[i]) + 2 AS n, {S.strip('l[i]')} <> '' AND NOT {_mid('l[i]')} AS safe FROM ps, range(1, len(l) + 1) r(i)),
    walk AS (SELECT doc_id, 1::BIGINT AS i, 1 AS g, n AS used, n >= 4500 OR (n >= 3000 AND safe) AS closed FROM it WHERE i = 1
        UNION ALL SELECT w.doc_id, w.i + 1, CASE WHEN w.closed THEN w.g + 1 ELSE w.g END, CASE WHEN w.closed THEN x.n ELSE w.used + x.n END,
            CASE WHEN w.closed THEN x.n ELSE w.used + x.n END >= 4500 OR (CASE WHEN w.closed THEN x.n ELSE w.used + x.n END >= 3000 AND x.safe)
        FROM walk w JOIN it x ON x.doc_id = w.doc_id AND x.i = w.i + 1),
    bc AS (SELECT doc_id, (g - 1)::INT AS chunk_no, string_agg(t, chr(10)||chr(10) ORDER BY i) AS text FROM walk JOIN it USING (doc_id, i) GROUP BY doc_id, g)"""


@register("boundary_chunks", BOUNDARY + " SELECT * FROM bc")
def boundary_chunks(spark, sf):
    return _rows(chunking.boundary_chunks(docs(spark, sf), separator=r"\n"))


def _side(expr: str) -> str:
    return S.strip(S.sub(expr, V.PAGE_MARKER, "", "m"))


@register("neighbour_context", BOUNDARY + f"""
    SELECT doc_id, chunk_no, CASE WHEN p IS NULL THEN '(문서 시작)' ELSE {_side('right(p, 300)')} END AS before, text,
        CASE WHEN n IS NULL THEN '(문서 끝)' ELSE {_side('left(n, 300)')} END AS after
    FROM (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n FROM bc WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no))""")
def neighbour_context(spark, sf):
    return chunking.neighbour_context(chunking.boundary_chunks(docs(spark, sf), separator=r"\n"))


CORRECTED = "CASE WHEN contains({0}, '#') THEN left({0}, len({0}) // 2) ELSE replace({0}, '|', ' ') END"


def _corrected(text):
    """A stand-in correction: halves noisy chunks (must be refused) and blanks table marks."""
    return F.when(text.contains("#"), F.left(text, (F.length(text) / 2).cast("int"))).otherwise(
        F.replace(text, F.lit("|"), F.lit(" "))
    )


_VISIBLE = f"len({S.sub('{0}', chr(92) + 's').replace('{', '{{').replace('}', '}}').replace('{{0}}', '{0}')})"
_ACCEPT = f"""
    c AS (SELECT *, {CORRECTED.format('text')} AS corrected FROM bc),
    a AS (SELECT *, {_VISIBLE.format('corrected')} / greatest({_VISIBLE.format('text')}, 1) BETWEEN 0.85 AND 1.15
        AND regexp_extract_all(text, '{S.re2(V.PAGE_MARKER, 'm')}') = regexp_extract_all(corrected, '{S.re2(V.PAGE_MARKER, 'm')}')
        AND {S.count('text', r'^\|', 'm')} = {S.count('corrected', r'^\|', 'm')} AS accepted FROM c)"""


def _corrections(spark, sf):
    rows = _rows(chunking.boundary_chunks(docs(spark, sf), separator=r"\n"))
    return chunking.accept_corrections(rows.withColumn("corrected", _corrected(F.col("text"))))


@register("corrections_accepted", BOUNDARY + f", {_ACCEPT} SELECT doc_id, chunk_no, accepted, CASE WHEN accepted THEN corrected ELSE text END AS result FROM a")
def corrections_accepted(spark, sf):
    return _corrections(spark, sf).select("doc_id", "chunk_no", "accepted", "result")


@register("correction_statistics", BOUNDARY + f", {_ACCEPT} SELECT doc_id, count(*) AS chunks, count(*) FILTER (NOT accepted) AS fallbacks FROM a GROUP BY doc_id")
def correction_statistics(spark, sf):
    return _corrections(spark, sf).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(~F.col("accepted")).alias("fallbacks"))


# --- chunk rows and statistics ---------------------------------------------------------------------------------------------------


@register("chunks_numbered", _pack("w.used + 2 + x.n > 1200 AND w.used >= 300") + """
    SELECT doc_id::VARCHAR || '_' || lpad(chunk_no::VARCHAR, 4, '0') AS chunk_id, doc_id, chunk_no AS chunk_index,
        count(*) OVER (PARTITION BY doc_id) AS total_chunks, text, len(text) AS chunk_size, 'basic' AS processing_method FROM bins""")
def chunks_numbered(spark, sf):
    return chunking.number_chunks(chunking.packed_paragraphs(docs(spark, sf), separator=NL), "basic")


@register("chunk_statistics", f"""WITH {SLIDING} SELECT count(*) AS chunks, round(avg(len(text)), 6) AS avg_size, min(len(text)) AS min_size,
    max(len(text)) AS max_size, sum(len(text))::BIGINT AS total_chars FROM sl""")
def chunk_statistics(spark, sf):
    return chunking.chunk_statistics(chunking.sliding_chunks(docs(spark, sf)))


@register("colophon_chunks_dropped", f"""WITH {SLIDING} SELECT doc_id, chunk_index FROM sl WHERE NOT {S.match('text', V.COLOPHON)}""")
def colophon_chunks_dropped(spark, sf):
    rows = chunking.sliding_chunks(docs(spark, sf))
    return rows.filter(~chunking.is_colophon(F.col("text"))).select("doc_id", "chunk_index")


@register("chunk_images_attached", f"""WITH {SLIDING}, {IMAGES.replace('WITH', '')}, per AS (SELECT doc_id, count(*) AS n FROM img GROUP BY doc_id)
    SELECT doc_id, chunk_index, coalesce(n, 0) AS image_count FROM sl LEFT JOIN per USING (doc_id)""")
def chunk_images_attached(spark, sf):
    rows = chunking.sliding_chunks(docs(spark, sf))
    return chunking.attach_images(rows, image_rows(spark, sf)).select("doc_id", "chunk_index", "image_count")


# --- semantic -----------------------------------------------------------------------------------------------------------------------

ITEMS = f"""
    ps AS (SELECT doc_id, i AS par, l[i] AS p FROM (SELECT doc_id, list_filter(list_transform({S.lines('text')}, lambda p: {S.strip('p')}), lambda p: p <> '') AS l FROM documents), range(1, len(l) + 1) r(i)),
    sx AS (SELECT doc_id, par, CASE WHEN len(p) > 1500 THEN {SENTENCES.replace('(text', '(p')} ELSE [p] END AS s FROM ps),
    it AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY par, j) AS i, s[j] AS t, len(s[j]) AS n, j = 1 AS fst FROM sx, range(1, len(s) + 1) r(j))"""
REFINED = _pack("(x.fst OR w.used + x.n > 1500)", ITEMS, 1, "' '")


@register("paragraphs_refined", REFINED + " SELECT * FROM bins")
def paragraphs_refined(spark, sf):
    listed = chunking.paragraph_lists(docs(spark, sf), separator=NL)
    return _rows(listed.withColumnRenamed("p", "chunks"))


KEYWORDS = f"""
    kwt AS (SELECT doc_id, chunk_no AS par_no, regexp_extract_all(text, '{S.re2(chunking.WORDS)}') AS w FROM bins),
    kwc AS (SELECT doc_id, par_no, term, count(*) / any_value(total) AS tf, min(pos) AS seen FROM
        (SELECT doc_id, par_no, w[k] AS term, k AS pos, len(w) AS total FROM kwt, range(1, len(w) + 1) r(k)) GROUP BY doc_id, par_no, term),
    kws AS (SELECT doc_id, par_no, term, seen, tf * CASE WHEN term IN {S.word_list(V.DOMAIN_KEYWORDS)} THEN 2.0 ELSE 1.0 END
        * CASE WHEN len(term) > 10 THEN 0.8 ELSE 1.0 END * CASE WHEN {S.match('term', r'^\d+$')} THEN 0.7 ELSE 1.0 END AS score FROM kwc),
    kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, par_no ORDER BY score DESC, seen) AS rank FROM kws) WHERE rank <= 20)"""


@register("paragraph_keywords", REFINED + f", {KEYWORDS} SELECT doc_id, par_no, rank, term, round(score, 6) AS score FROM kw")
def paragraph_keywords(spark, sf):
    listed = chunking.paragraph_lists(docs(spark, sf), separator=NL)
    per = listed.select("doc_id", F.posexplode(F.transform("p", lambda p: chunking.keywords(p))).alias("par_no", "kw"))
    rows = per.select("doc_id", "par_no", F.posexplode("kw"))
    return rows.select("doc_id", "par_no", (F.col("pos") + 1).alias("rank"), "col.term", F.round("col.score", 6).alias("score"))


def _cues() -> str:
    return " + ".join(f"CASE WHEN {S.contains_any('text', w)} THEN {V.TRANSITION_WEIGHTS[k]} ELSE 0.0 END" for k, w in V.TRANSITION_KEYWORDS.items())


TRANSITIONS = f"""
    kset AS (SELECT b.doc_id, b.chunk_no AS par_no, b.text, coalesce(list(k.term) FILTER (k.term IS NOT NULL), []) AS ks
        FROM bins b LEFT JOIN kw k ON k.doc_id = b.doc_id AND k.par_no = b.chunk_no GROUP BY ALL),
    near AS (SELECT *, lag(ks) OVER w AS prev FROM kset WINDOW w AS (PARTITION BY doc_id ORDER BY par_no)),
    jac AS (SELECT *, CASE WHEN len(ks) > 0 AND len(prev) > 0 THEN len(list_intersect(ks, prev)) / len(list_distinct(list_concat(ks, prev))) END AS j FROM near),
    tr AS (SELECT doc_id, par_no, j, CASE WHEN par_no = 0 THEN 0.0 ELSE {_cues()} + CASE WHEN j < 0.3 THEN (1.0 - j) * 2.0 ELSE 0.0 END
        + CASE WHEN {S.match_any('text', V.TRANSITION_STRUCTURES)} THEN 3.0 ELSE 0.0 END END AS score FROM jac)"""


@register("topic_transitions", REFINED + f", {KEYWORDS}, {TRANSITIONS} SELECT doc_id, par_no, round(score::DOUBLE, 6) AS score, score >= 2.0 AS boundary FROM tr")
def topic_transitions(spark, sf):
    marked = chunking.topic_boundaries(chunking.paragraph_lists(docs(spark, sf), separator=NL))
    rows = marked.select("doc_id", F.posexplode(F.arrays_zip("score", "first")))
    return rows.select("doc_id", F.col("pos").alias("par_no"), F.round("col.score", 6).alias("score"), F.col("col.first").alias("boundary"))


@register("topic_boundaries_adjusted", REFINED + f""", {KEYWORDS}, {TRANSITIONS},
    st AS MATERIALIZED (SELECT doc_id, par_no, score >= 2.0 AS b, j FROM tr),
    fold AS (SELECT doc_id, 0 AS par_no, b FROM st WHERE par_no = 0
        UNION ALL SELECT f.doc_id, f.par_no + 1, CASE WHEN f.b OR s.j IS NULL THEN s.b WHEN s.j > 0.7 THEN false WHEN s.j < 0.2 THEN true ELSE s.b END
        FROM fold f JOIN st s ON s.doc_id = f.doc_id AND s.par_no = f.par_no + 1)
    SELECT doc_id, par_no, b AS boundary FROM fold""")
def topic_boundaries_adjusted(spark, sf):
    marked = chunking.topic_boundaries(chunking.paragraph_lists(docs(spark, sf), separator=NL))
    return marked.select("doc_id", F.posexplode("final").alias("par_no", "boundary"))


@register("semantic_chunks")
def semantic_chunks(spark, sf):
    rows = chunking.chunk_topics(chunking.semantic_chunks(docs(spark, sf), separator=NL))
    terms = F.transform(F.slice("kw", 1, 20), lambda k: k["term"])
    return rows.select(
        "doc_id", "chunk_no", F.length("text").alias("chunk_size"), F.md5("text").alias("digest"), T.join(terms, " ").alias("keywords"),
        F.round("topic_coherence", 6).alias("topic_coherence"), F.round("domain_relevance", 6).alias("domain_relevance"),
    )


@register("semantic_statistics")
def semantic_statistics(spark, sf):
    rows = chunking.chunk_topics(chunking.semantic_chunks(docs(spark, sf), separator=NL))
    return rows.agg(
        F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 6).alias("avg_size"), F.min(F.length("text")).alias("min_size"),
        F.max(F.length("text")).alias("max_size"), F.round(F.avg("topic_coherence"), 6).alias("avg_coherence"),
        F.round(F.avg("domain_relevance"), 6).alias("avg_domain_relevance"), F.sum(F.size("kw")).alias("keywords"),
    )


@register("keyword_coherence", REFINED + f""", {KEYWORDS},
    top AS (SELECT doc_id, par_no, count(*) AS n, stddev_pop(score) AS sd FROM kw WHERE rank <= 10 GROUP BY ALL),
    dom AS (SELECT doc_id, par_no, sum(score) AS total, coalesce(sum(score) FILTER (term IN {S.word_list(V.DOMAIN_KEYWORDS)}), 0) AS d FROM kw GROUP BY ALL)
    SELECT b.doc_id, b.chunk_no, round(CASE WHEN n IS NULL THEN 0 WHEN n < 2 THEN 0.5 ELSE 1.0 / (1.0 + sd) END::DOUBLE, 6) AS topic_coherence,
        round(coalesce(d / total, 0)::DOUBLE, 6) AS domain_relevance
    FROM bins b LEFT JOIN top t ON t.doc_id = b.doc_id AND t.par_no = b.chunk_no LEFT JOIN dom m ON m.doc_id = b.doc_id AND m.par_no = b.chunk_no""")
def keyword_coherence(spark, sf):
    listed = chunking.paragraph_lists(docs(spark, sf), separator=NL)
    rows = listed.select("doc_id", F.posexplode("p").alias("chunk_no", "text")).withColumn("kw", chunking.keywords(F.col("text")))
    scored = chunking.chunk_topics(rows)
    return scored.select(
        "doc_id", "chunk_no", F.round("topic_coherence", 6).alias("topic_coherence"), F.round("domain_relevance", 6).alias("domain_relevance")
    )


# --- keywords per document -------------------------------------------------------------------------------------------------------------


@register("document_keywords", f"""
    WITH t AS (SELECT doc_id, {S.words(S.sub('text', r'[^\w\s]+', ' '))} AS w FROM documents),
    c AS (SELECT doc_id, term, count(*) AS freq, min(k) AS seen FROM (SELECT doc_id, w[k] AS term, k FROM t, range(1, len(w) + 1) r(k))
        WHERE len(term) > 1 AND term NOT IN {S.word_list(V.CLEAN_STOPWORDS)} GROUP BY doc_id, term)
    SELECT doc_id, rank, term, freq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, seen) AS rank FROM c) WHERE rank <= 10""")
def document_keywords(spark, sf):
    words = T.split_words(T.clean_for_keywords(F.col("text"), remove_stopwords=True))

    def best(ws):
        rows = F.transform(T.first_seen_counts(ws), lambda r: F.struct((-r["n"]).alias("n"), r["first"].alias("at"), r["item"].alias("term")))
        return F.slice(F.sort_array(rows), 1, 10)

    listed = docs(spark, sf).select("doc_id", F.posexplode(T.let(words, best)))
    return listed.select("doc_id", (F.col("pos") + 1).alias("rank"), "col.term", (-F.col("col.n")).alias("freq"))
