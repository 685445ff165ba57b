"""Quality scores, token budgets and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import chunking, lexical, quality, reports
from corpusflow.plans import sql as S
from corpusflow.plans.registry import register
from corpusflow.plans.retrieval import TFIDF, passages, threshold
from corpusflow.plans.structure import MD, page_markdown
from corpusflow.functions import sentences as L
from corpusflow.session import table
from corpusflow.sources import store, transcripts


def _completion(t: str = "text") -> str:
    rows = f"""list_filter(list_transform({S.lines(t)}, lambda x: {S.strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT {S.match('x', r'^\d+\)')} AND NOT contains(x, '........'))"""
    bad = f"list_filter({rows}, lambda x: NOT {S.ends_with('x', V.COMPLETE_ENDINGS)} AND {S.match('x', L.SIMPLE)})"
    return f"CASE WHEN len({rows}) = 0 THEN 100.0::DOUBLE ELSE (len({rows}) - len({bad})) / len({rows}) * 100 END"


def _levels(pattern: str, t: str = "text") -> str:
    return f"list_transform(regexp_extract_all({t}, '{S.re2(pattern, 'm')}', 1), lambda h: len(h))"


def _jumps(levels: str, limit: int, first: str) -> str:
    return f"len(list_filter(range(1, len({levels}) + 1), lambda i: {levels}[i] - coalesce({levels}[i - 1], {first}) > {limit}))"


def _structure(t: str = "text") -> str:
    lv = _levels(r"^(#+)\s+.+$", t)
    raw = f"(100.0 - 5 * {_jumps(lv, 2, 'NULL')})"
    listed = f"({S.match(t, r'^\s*[-*+]\s+.+$', 'm')} OR {S.match(t, r'^\s*\d+\.\s+.+$', 'm')})"
    return f"greatest(70.0, CASE WHEN len({lv}) > 0 OR {listed} THEN least(100.0, {raw} + 5) ELSE {raw} END)::DOUBLE"


PAGE_QUALITY = f"""{MD},
    sc AS (SELECT page_id, {_completion()} AS sentence, {_structure()} AS structure FROM md),
    tq AS (SELECT *, sentence * 0.4 + 85.0 * 0.3 + 80.0 * 0.2 + structure * 0.1 AS total FROM sc)"""


@register("sentence_completion", f"SELECT doc_id, round({_completion()}, 6) AS score FROM documents")
def sentence_completion(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(quality.sentence_completion(F.col("text")), 6).alias("score"))


@register("structure_preservation", f"WITH {MD} SELECT page_id, {_structure()} AS score FROM md")
def structure_preservation(spark, sf):
    return page_markdown(spark, sf).select("page_id", quality.structure_preservation(F.col("text")).alias("score"))


_NOTES = ", ".join(f"CASE WHEN {n} < {limit} THEN {S.quote(note)} END" for (n, limit, note) in (
    ("sentence", 85, V.IMPROVEMENTS[0][2]), ("85.0", 85, V.IMPROVEMENTS[1][2]), ("80.0", 80, V.IMPROVEMENTS[2][2]), ("structure", 80, V.IMPROVEMENTS[3][2])))


@register("quality_totals", f"""WITH {PAGE_QUALITY} SELECT page_id, round(sentence, 6) AS sentence, structure, round(total, 4) AS total, total >= 90 AS passed,
    CASE WHEN concat_ws('|', {_NOTES}) = '' THEN '{V.NO_IMPROVEMENT}' ELSE concat_ws('|', {_NOTES}) END AS improvements FROM tq""")
def quality_totals(spark, sf):
    rows = page_markdown(spark, sf).select(
        "page_id", quality.sentence_completion(F.col("text")).alias("sentence"), quality.structure_preservation(F.col("text")).alias("structure")
    )
    parts = (F.col("sentence"), F.lit(85.0), F.lit(80.0), F.col("structure"))
    total = sum((p * w for p, w in zip(parts, V.QUALITY_WEIGHTS)), F.lit(0.0))
    return rows.select(
        "page_id", F.round("sentence", 6).alias("sentence"), "structure", F.round(total, 4).alias("total"),
        quality.total_quality(*parts)["passed"].alias("passed"), T.join(quality.improvements(*parts), "|").alias("improvements"),
    )


def _context(t: str = "text") -> str:
    broken = " + ".join(S.count(t, p) for p in V.BROKEN_CONTEXT)
    return f"((greatest(0.0, 1.0 - ({broken}) / greatest(len({S.lines(t)}) * 0.1, 1.0)) + 0.7) / 2)"


def _heading_quality(t: str = "text") -> str:
    lv = _levels(r"^(#{1,6})\s+.+$", t)
    return f"""greatest(0.0, CASE WHEN len({lv}) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - {_jumps(lv, 1, '0')} * 0.2) END
        - {S.count(t, r'^###\s*[가-힣]{1,2}\.\s*$', 'm')} * 0.1 - {S.count(t, r'^#{1,6}\s*$', 'm')} * 0.05)"""


def _readability(t: str = "text") -> str:
    s = f"regexp_split_to_array({t}, '{S.re2(r'[.!?]\s+')}')"
    return f"""greatest(0.0, 1.0 - (({S.count(t, chr(92) + 'n{4,}')} > 0)::INT + (len(list_filter({s}, lambda x: len(x) > 200)) > len({s}) * 0.2)::INT
        + ({S.count(t, quality.ODD_CHARACTERS)} > 20)::INT) * 0.1)"""


_REPORT = f"""{MD},
    rp AS (SELECT page_id, {_context()}::DOUBLE AS c, {_heading_quality()}::DOUBLE AS s, {_readability()}::DOUBLE AS r FROM md)"""


@register("quality_report", f"""WITH {_REPORT} SELECT page_id, round(c, 6) AS context_score, round(s, 6) AS structure_score, round(r, 6) AS readability_score, round((c + s + r) / 3, 6) AS overall_score,
    CASE WHEN (c + s + r) / 3 < 0.8 THEN concat_ws('|', CASE WHEN c < 0.7 THEN '{V.REPORT_IMPROVEMENTS[0][1]}' END, CASE WHEN s < 0.7 THEN '{V.REPORT_IMPROVEMENTS[1][1]}' END, CASE WHEN r < 0.7 THEN '{V.REPORT_IMPROVEMENTS[2][1]}' END) ELSE '' END AS improvements FROM rp""")
def quality_report(spark, sf):
    parts = quality.report(F.col("text"))
    return page_markdown(spark, sf).select(
        "page_id", *(F.round(parts[n], 6).alias(n) for n in ("context_score", "structure_score", "readability_score", "overall_score")),
        T.join(parts["improvements"], "|").alias("improvements"),
    )


@register("document_readability", f"SELECT doc_id, round({_readability()}::DOUBLE, 6) AS readability, round({_context()}::DOUBLE, 6) AS context FROM documents")
def document_readability(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.round(quality.readability(F.col("text")), 6).alias("readability"), F.round(quality.context_quality(F.col("text")), 6).alias("context")
    )


@register("quality_by_label", f"""SELECT quality, count(*) AS documents, round(avg({_completion()}), 6) AS completion, round(avg({_readability()}::DOUBLE), 6) AS readability
    FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def quality_by_label(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("quality").agg(
        F.count("*").alias("documents"), F.round(F.avg(quality.sentence_completion(F.col("text"))), 6).alias("completion"),
        F.round(F.avg(quality.readability(F.col("text"))), 6).alias("readability"),
    )


_BODY = f"list_filter({S.lines('text')}, lambda x: {S.strip('x')} <> '' AND NOT starts_with({S.strip('x')}, '#'))"
_LN = S.lines("text")


@register("quality_samples", f"""SELECT doc_id, left({S.join(_BODY)}, 500) AS body, {S.join(f"(list_filter(list_transform(list_filter({_LN}, lambda x, i: (i - 1) % greatest(1, len({_LN}) // 20) = 0), lambda x: {S.strip('x')}), lambda x: len(x) > 10 AND NOT starts_with(x, '#')))[1:20]")} AS lines FROM documents""")
def quality_samples(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", quality.body_sample(F.col("text")).alias("body"), T.join(quality.spaced_sample(F.col("text"))).alias("lines")
    )


@register("outputs_compared", f"""
    WITH a AS (SELECT doc_id, text AS t FROM documents), b AS (SELECT doc_id, {S.sub(S.strip('text'), r'\s+', ' ')} AS t FROM documents),
    q AS (SELECT doc_id, len(a.t) AS first_length, len({S.lines('a.t')}) AS first_lines, round({_readability('a.t')}::DOUBLE, 6) AS first_quality,
        len(b.t) AS second_length, len({S.lines('b.t')}) AS second_lines, round({_readability('b.t')}::DOUBLE, 6) AS second_quality FROM a JOIN b USING (doc_id))
    SELECT *, round((first_quality - second_quality) / greatest(second_quality, 0.1) * 100, 6) AS improvement FROM q""")
def outputs_compared(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    flat = docs.select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))
    return reports.compare_outputs(docs, flat, quality.readability)


# --- tokens and budgets ----------------------------------------------------------------------------------------------------------

MODEL = "CASE WHEN n > 6 THEN 'gpt-4' WHEN n > 4 THEN 'gpt-3.5-turbo' WHEN n > 2 THEN 'gemini-1.0-pro' ELSE 'unknown' END"
PROVIDER = "CASE WHEN n > 4 THEN 'openai' WHEN n > 2 THEN 'google' ELSE 'other' END"


def _conversations(spark, sf):
    rows = table(spark, sf, "conversations")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    return rows.join(sizes.select("conv_id", F.expr(MODEL).alias("model"), F.expr(PROVIDER).alias("provider")), "conv_id")


CONVERSATIONS = f"""
    cn AS (SELECT conv_id, {MODEL} AS model, {PROVIDER} AS provider FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)),
    ct AS (SELECT conv_id, any_value(model) AS model, any_value(provider) AS provider,
        (sum(CASE WHEN contains(model, 'gpt-3.5') OR contains(model, 'gpt-4') THEN 3 ELSE 4 END + len(role) // 4 + len(text) // 4) + 3)::BIGINT AS messages_tokens, (sum(len(text)) // 4)::BIGINT AS documents_tokens
        FROM conversations JOIN cn USING (conv_id) GROUP BY conv_id)"""


@register("conversation_tokens", f"WITH {CONVERSATIONS} SELECT conv_id, messages_tokens FROM ct")
def conversation_tokens(spark, sf):
    return reports.conversation_tokens(_conversations(spark, sf), F.col("model"))


_MAX = "CASE " + " ".join(f"WHEN provider = '{p}' AND model = '{m}' THEN {n}" for p, m, n in V.MODEL_LIMITS) + " WHEN provider = 'openai' THEN 16385 WHEN provider = 'google' THEN 1048576 ELSE 4096 END"


@register("context_usage", f"""WITH {CONVERSATIONS}, u AS (SELECT *, messages_tokens + documents_tokens + 500 AS total_tokens, ({_MAX})::BIGINT AS max_tokens FROM ct)
    SELECT conv_id, total_tokens, max_tokens, max_tokens - total_tokens AS remaining_tokens, round(total_tokens / max_tokens * 100, 6) AS usage_percentage, total_tokens > max_tokens AS is_over_limit,
        CASE WHEN total_tokens > max_tokens THEN '🔴 초과' WHEN total_tokens / max_tokens * 100 > 80 THEN '🟡 주의' ELSE '🟢 정상' END AS status,
        greatest(4000, least(CASE WHEN provider = 'openai' AND contains(model, 'gpt-3.5') THEN 30000 ELSE 500000 END, trunc((max_tokens - messages_tokens - 800) * 0.7::DOUBLE)::BIGINT * 4)) AS budget_chars FROM u""")
def context_usage(spark, sf):
    rows = _conversations(spark, sf)
    counted = reports.conversation_tokens(rows, F.col("model"))
    extra = rows.groupBy("conv_id").agg(
        F.floor(F.sum(F.length("text")) / 4).cast("bigint").alias("documents_tokens"), F.first("model").alias("model"), F.first("provider").alias("provider")
    )
    used = reports.context_usage(counted.join(extra, "conv_id"))
    budget = reports.context_budget(F.col("max_tokens"), F.col("messages_tokens"), F.col("provider"), F.col("model"))
    return used.select(
        "conv_id", "total_tokens", "max_tokens", "remaining_tokens", "usage_percentage", "is_over_limit", "status", budget.alias("budget_chars")
    )


# --- loads, stores, transcripts ---------------------------------------------------------------------------------------------------------


@register("file_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch_no FROM documents")
def file_batches(spark, sf):
    return reports.batches(table(spark, sf, "documents").select("doc_id"))


@register("load_status", f"""WITH p AS (SELECT doc_id, n_chars, unnest({S.lines('text')}) AS t FROM documents), k AS (SELECT * FROM p)
    SELECT doc_id, n_chars AS original_length, coalesce(sum(len(t)), 0)::BIGINT AS processed_length, count(t) AS document_count, count(t) > 0 AS success,
        CASE WHEN count(t) = 0 THEN '문서를 추출할 수 없습니다' END AS error FROM (SELECT d.doc_id, d.n_chars, k.t FROM documents d LEFT JOIN k USING (doc_id)) GROUP BY ALL""")
def load_status(spark, sf):
    docs = table(spark, sf, "documents")
    return reports.load_status(docs.select("doc_id", F.col("n_chars").alias("original_length"), F.explode_outer(T.lines(F.col("text"))).alias("text")))


# the first write holds every document, the second one the documents with an even id in a newer version
@register("store_upserted", """SELECT doc_id::VARCHAR AS file_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS version,
    CASE WHEN doc_id % 2 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents""")
def store_upserted(spark, sf):
    """Current rows of a store in which a later write has replaced some of the files."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_id"), "n_chars")
    first = docs.select("file_id", F.lit(1).alias("version"), "n_chars", F.lit("w1").alias(store.WRITE))
    second = docs.filter(F.col("doc_id") % 2 == 0).select("file_id", F.lit(2).alias("version"), (F.col("n_chars") + 1).alias("n_chars"), F.lit("w2").alias(store.WRITE))
    return store.latest(first.unionByName(second)).drop(store.WRITE)


@register("documents_concatenated", f"SELECT doc_id, {S.join(S.lines('text'), chr(10) * 2)} AS out FROM documents")
def documents_concatenated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.join(T.lines(F.col("text")), "\n\n").alias("out"))


@register("store_statistics", """SELECT (SELECT count(*) FROM documents) AS total_documents, count(*) AS total_vectors, max(len(embedding)) AS dimension, 1.5::DOUBLE AS distance_threshold,
    0.3::DOUBLE AS similarity_threshold, (SELECT count(*) FROM documents) > 0 AS keyword_search_available FROM embeddings""")
def store_statistics(spark, sf):
    return reports.store_statistics(table(spark, sf, "documents"), table(spark, sf, "embeddings"))


@register("rebuild_report", """WITH f AS (SELECT len(text) >= 100 AS success, ceil(len(text) / 150)::BIGINT AS chunks, len(text) / 1000 AS processing_time FROM documents)
    SELECT count(*) AS total_files, count(*) FILTER (success) AS processed_files, count(*) FILTER (NOT success) AS failed_files, coalesce(sum(chunks) FILTER (success), 0)::BIGINT AS total_chunks, round(sum(processing_time), 6) AS processing_time FROM f""")
def rebuild_report(spark, sf):
    n = F.length("text")
    files = table(spark, sf, "documents").select((n >= 100).alias("success"), F.ceil(n / 150).alias("chunks"), (n / 1000).alias("processing_time"))
    return reports.rebuild_report(files)


@register("store_records", "SELECT coalesce(source || '_' || lpad(doc_id::VARCHAR, 6, '0'), 'doc_' || doc_id) AS id, text AS content FROM documents")
def store_records(spark, sf):
    docs = table(spark, sf, "documents")
    identifier = F.coalesce(F.concat("source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return reports.store_records(docs, identifier).select("id", "content")


@register("upload_summary", """SELECT doc_id, 'sliding' AS processing_method, count(*) AS chunks, sum(n)::BIGINT AS characters
    FROM (SELECT doc_id, len(substr(text, s::INT, 150)) AS n FROM documents, generate_series(1, greatest(len(text) - 50, 1), 100) g(s) WHERE text <> '') GROUP BY doc_id""")
def upload_summary(spark, sf):
    rows = chunking.sliding_chunks(table(spark, sf, "documents"))
    return reports.upload_summary(rows.withColumn("processing_method", F.lit("sliding")).withColumn("chunk_size", F.length("text")))


@register("transcript_entries", """SELECT conv_id, n AS entry_no, '## ' || n || '. ' || CASE WHEN role = 'user' THEN '사용자' ELSE '어시스턴트' END || chr(10) || text || chr(10)||chr(10) || '---' || chr(10) AS entry
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS n FROM conversations)""")
def transcript_entries(spark, sf):
    return transcripts.transcript_entries(table(spark, sf, "conversations"))


@register("markdown_files", """SELECT doc_id, '# doc_' || doc_id || chr(10)||chr(10) || '**원본 파일**: ' || source || chr(10) || '**변환 시간**: 2024-01-01 00:00:00' || chr(10) || '**처리 방법**: pypdf' || chr(10) || '**추출된 이미지**: ' || n_chars // 1000 || '개' || chr(10)||chr(10) || '---' || chr(10)||chr(10) || text AS content FROM documents""")
def markdown_files(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    content = transcripts.markdown_file(name, F.col("source"), F.lit("2024-01-01 00:00:00"), F.lit("pypdf"), F.floor(F.col("n_chars") / 1000), F.col("text"))
    return docs.select("doc_id", content.alias("content"))


@register("performance_records", """SELECT conv_id, turn, len(text) / 1000 AS processing_time, len(text) AS response_length, (len(text) // 4)::BIGINT AS total_tokens,
    left(text, 200) AS content_preview, CASE WHEN role = '' THEN 'Unknown' ELSE replace(role, '+', ' ') END AS name FROM conversations""")
def performance_records(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", (F.length("text") / 1000).alias("processing_time"), F.length("text").alias("response_length"), reports.tokens(F.col("text")).alias("total_tokens"),
        F.left("text", F.lit(200)).alias("content_preview"), T.display_name(F.col("role")).alias("name"),
    )
