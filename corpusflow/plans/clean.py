"""Cleaning, normalising and per-text statistics over `documents`, `pages` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import dedup
from corpusflow.operators.lexical import explode_once
from corpusflow.plans import sql as S
from corpusflow.plans.registry import register
from corpusflow.session import table

# --- equivalents ---------------------------------------------------------------------------------------------------------

PLAIN = "translate({0}, chr(160)||chr(12288)||chr(8203)||chr(65279), '  ')"


def _junk(expr: str) -> str:
    text = S.chain(expr, (V.PLACEHOLDER_IMAGE,), (V.MARKDOWN_IMAGE, "$1"), (V.MODEL_BOX_TOKEN,))
    return S.join(f"list_filter({S.lines(text)}, lambda l: NOT {S.match_any(S.strip('l'), V.JUNK_LINES)})")


CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _basic(expr: str) -> str:
    out = S.chain(expr, (r"\n\s*\n\s*\n", "\n\n"), (r" +", " "))
    return S.strip(S.sub(PLAIN.format(out), CONTROLS))


def _general(expr: str) -> str:
    out = S.chain(PLAIN.format(expr), (r" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (CONTROLS,))
    return S.strip(S.translate(out, V.FULLWIDTH_PUNCTUATION))


def _markdown(expr: str) -> str:
    return _general(S.chain(
        S.strip(expr),
        (r"^---\n.*?\n---\n", "", "s"),
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"```[a-zA-Z]*\n", ""), (r"```", ""), (r"`([^`]+)`", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
        (r"^#{1,6}\s+", "", "m"), (r"^[-*+]\s+", "", "m"), (r"^\d+\.\s+", "", "m"),
    ))


def _hangul(expr: str) -> str:
    return S.chain(S.translate(expr, V.FULLWIDTH_PUNCTUATION), (r"─{2,}", "─"), (r"={3,}", "==="), (r"-{3,}", "---"))


def _structure(expr: str) -> str:
    bare = S.strip("l")
    heading = S.match(bare, r"^\d+\.?\s+[가-힣]")
    return S.join(
        f"list_transform({S.lines(expr)}, lambda l: CASE WHEN {heading} THEN chr(10)||{bare}||chr(10) ELSE {bare} END)"
    )


def _patterns(expr: str, preserve: bool = True) -> str:
    rules = [(r"<[^>]+>",), (r"&[a-zA-Z0-9#]+;",)]
    if preserve:
        rules += [(r"[ \t]+$", "", "m"), (r"\n{3,}", "\n\n")]
    else:
        rules += [(r"\s{2,}", " "), (r"\n{3,}", "\n\n"), (r"[ \t]+$", "", "m")]
    rules += [(r"\b\d+\s*페이지\b|\bPage\s*\d+\b", "", "i"), (r"\[\d+\]|\(\d+\)",), (r"([.,!?;:]){2,}", "$1")]
    out = S.strip(S.chain(expr, *rules))
    return f"CASE WHEN {S.strip(expr)} = '' THEN '' WHEN {out} = '' THEN {S.strip(expr)} ELSE {out} END"


def _punctuation(expr: str) -> str:
    return S.chain(
        S.translate(expr, V.HANGUL_PUNCTUATION),
        (r"([가-힣])([a-zA-Z])", "$1 $2"), (r"([a-zA-Z])([가-힣])", "$1 $2"), (r"([가-힣])\s+([.,!?;:])", "$1$2"),
    )


def _search(expr: str) -> str:
    return S.strip(S.chain(
        _punctuation(_patterns(expr, False)), (r"(\d+)\s*([가-힣]{1,2})", "$1$2"), (r"(\d{4})\s*년", "$1년")
    ))


def keywords_clean(expr: str, stop: bool = False) -> str:
    out = f"translate({S.sub(S.strip(expr), r'\s+', ' ')}, chr(8203)||chr(65279), '')"
    out = S.strip(S.chain(out, (r"[^\w\s]+", " "), (r"\s+", " ")))
    if stop:
        kept = f"list_filter({S.words(out)}, lambda w: len(w) > 1 AND w NOT IN {S.word_list(V.CLEAN_STOPWORDS)})"
        out = S.join(kept, " ")
    return out


def _text_query(name: str, function, expression: str, source: str = "documents", key="doc_id", field="text"):
    """One cleaning function applied to one text column: a single map stage without a shuffle."""
    register(name, f"SELECT {key}, {expression} AS out FROM {source}")(
        lambda spark, sf: table(spark, sf, source).select(*key.split(", "), function(F.col(field)).alias("out"))
    )


_text_query("junk_lines_removed", T.drop_junk_lines, _junk("text"))
_text_query("markdown_cleaned", T.clean_markdown, _markdown("text"))
_text_query("general_cleaned", T.clean_general, _general("text"))
_text_query("basic_cleaned", T.clean_basic, _basic("text"))
_text_query("hangul_normalized", T.normalize_hangul_text, _hangul("text"))
_text_query("structure_kept", T.keep_structure, _structure("text"))
_text_query("page_patterns_cleaned", T.clean_patterns, _patterns("html"), "pages", "page_id", "html")
_text_query(
    "page_patterns_cleaned_flat", lambda c: T.clean_patterns(c, False), _patterns("html", False), "pages", "page_id", "html"
)
_text_query("punctuation_normalized", T.normalize_punctuation, _punctuation("text"))
_text_query("markdown_to_text", T.markdown_to_text, S.chain(
    "text",
    (r"^(#{1,6})\s*(.+?)$", "$2", "m"), (r"!\[([^\]]*)\]\(([^)]+)\)", "$1"), (r"\[([^\]]+)\]\(([^)]+)\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"),
    (r"^\s*[-*+]\s+(.+)$", "$1", "m"), (r"^\s*\d+\.\s+(.+)$", "$1", "m"), (r"^>\s*(.+)$", "$1", "m"),
    (r"^[-*_]{3,}$", "", "m"),
))
_text_query("search_optimized", T.optimize_for_search, _search("text"))
_text_query("keywords_cleaned", T.clean_for_keywords, keywords_clean("text"))
_text_query("keywords_cleaned_stopwords", lambda c: T.clean_for_keywords(c, True), keywords_clean("text", True))
_text_query("whitespace_normalized", T.normalize_whitespace, S.sub(S.strip("text"), r"\s+", " "))
_text_query("special_chars_removed", T.remove_special_chars, S.sub("text", r"[^\w\s]", " "))
_text_query(
    "special_chars_removed_punctuation_kept",
    lambda c: T.remove_special_chars(c, True), S.sub("text", r"[^\w\s.,!?;:\-()]", " "),
)
_text_query("text_validity", T.is_valid_text, f"len({keywords_clean('text')}) >= 10")
_text_query(
    "minimal_cleaned", T.clean_minimal, f"translate({S.sub(S.strip('text'), r'\s+', ' ')}, chr(8203)||chr(65279), '')"
)
_text_query("secrets_redacted", T.redact_secrets, S.chain("text", *((p, V.SECRET_MASK) for p in V.SECRET_PATTERNS)))
_text_query("artifacts_stripped", T.strip_artifacts, S.strip(S.sub(
    S.chain("text", *((p, "", "m") for p in V.ARTIFACT_PATTERNS)), r"\n{3,}", "\n\n"
)), "conversations", "conv_id, turn")
_ROWS = f"list_filter(regexp_split_to_array(text, '{S.re2(chr(92) + 's*' + chr(92) + 'n' + chr(92) + 's*')}'), lambda l: {S.strip('l')} <> '')"
_KEPT = (
    f"list_filter({_ROWS}, lambda l: NOT {S.match_any('l', V.CONTEXT_BANNED_LINES)}"
    f" AND {S.strip('l')} NOT IN {S.word_list(V.CONTEXT_ROLE_LINES)})"
)
_text_query(
    "context_cleaned", T.clean_context,
    f"CASE WHEN len({_KEPT}) > 0 THEN {S.join(_KEPT)} ELSE {S.strip(S.sub('text', r'\s+', ' '))} END",
)
_OUT = "replace(replace(text, '<|im_start|>', ''), '<|im_end|>', '')"
_text_query("output_cleaned", T.clean_output, S.join(
    f"list_filter({S.lines(S.sub(_OUT, r'\n$'))}, lambda l: NOT {S.contains_any('l', V.OUTPUT_BANNED_FRAGMENTS)}"
    f" AND NOT {S.starts_with('lower(' + S.strip('l') + ')', V.OUTPUT_ROLE_PREFIXES)})"
), "conversations", "conv_id, turn")
_text_query(
    "markup_escaped", T.inline_markup,
    S.sub("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
)
_INDENT = f"regexp_extract(l, '^[{S.re2(r'[\s]')[1:-1]}]*')"
_BARE = f"substr(l, len({_INDENT}) + 1)"
_LISTS = (
    f"list_transform({S.lines(S.sub('text', r'\n$'))}, lambda l: CASE WHEN {S.match(_BARE, r'^\d+[.)]\s+')} THEN"
    f" {_INDENT} || '- ' || {S.strip(S.sub(_BARE, r'^\d+[.)]\s+'))} WHEN starts_with({_BARE}, '•') THEN"
    f" {_INDENT} || '- ' || {S.strip(S.sub(_BARE, r'^•+'))} ELSE l END)"
)
_text_query("lists_normalized", T.normalize_lists, S.strip(S.join(_LISTS)))
_text_query("noise_lines_stripped", T.strip_noise_lines, S.chain(
    "text", (r"\n\s*\n\s*\n", "\n\n"), (r"^[Pp]age\s*\d+.*$", "", "m"), (r"^\s*\d+\s*$", "", "m"),
    (r"^\s*-\s*\d+\s*-\s*$", "", "m"),
))
_text_query("headings_fixed", lambda c: T.collapse_blank_lines(T.fix_headings(c)), S.chain(
    "text", (r"^###\s*다\.\s*$", "다.", "m"), (r"^###\s(\s*[가-힣]\.\s*)$", "$1", "m"), (r"\n{3,}", "\n\n")
))
_text_query("page_markers_dropped", T.drop_page_markers, S.strip(S.sub("text", V.PAGE_MARKER, "", "m")))
_text_query(
    "error_message_guard", T.is_error_message,
    f"len(text) <= 280 AND {S.contains_any('lower(text)', V.ERROR_KEYWORDS)}", "conversations", "conv_id, turn",
)
_text_query("answer_markdown_repaired", T.repair_answer_markdown, S.strip(S.sub(
    S.chain(
        "replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10))",
        (r"([^\s#])[ \t]*(#{1,6})[ \t]+([^\s])", "$1\n\n$2 $3"),
        (r"([^\s])[ \t]{2,}[-*][ \t]+", "$1\n- "),
    ), r"\n{3,}", "\n\n"
)))


def _long_enough(made):
    """Rows whose text is long enough; the array of one text keeps the filter from computing the text a second time."""
    return explode_once(made, "o", "out").filter(F.length(T.strip(F.col("out"))) >= 100)


@register("preprocessed_documents", f"""
    SELECT doc_id, out FROM (SELECT doc_id, {_structure(_hangul(_basic(_junk('text'))))} AS out FROM documents)
    WHERE len({S.strip('out')}) >= 100""")
def preprocessed_documents(spark, sf):
    return _long_enough(table(spark, sf, "documents").select("doc_id", F.array(T.preprocess(F.col("text"))).alias("o")))


@register("preprocessed_markdown", f"""
    SELECT doc_id, out FROM (SELECT doc_id, {_structure(_hangul(_markdown(_junk('text'))))} AS out FROM documents)
    WHERE len({S.strip('out')}) >= 100""")
def preprocessed_markdown(spark, sf):
    return _long_enough(table(spark, sf, "documents").select("doc_id", F.array(T.preprocess(F.col("text"), markdown=True)).alias("o")))


_BATCH = f"""
    WITH a AS (SELECT doc_id, {_patterns('text', False)} AS t FROM documents WHERE {S.strip('text')} <> ''),
    b AS (SELECT doc_id, {_punctuation('t')} AS t FROM a),
    c AS (SELECT doc_id, {_patterns('t', False)} AS t FROM b),
    clean AS (SELECT doc_id, {S.strip(S.chain(_punctuation('t'), (r"(\d+)\s*([가-힣]{1,2})", "$1$2"), (r"(\d{4})\s*년", "$1년")))} AS out FROM c),
    keyed AS (SELECT *, lower({S.strip('out')}) AS k FROM clean WHERE {S.strip('out')} <> '')
    SELECT doc_id, out FROM keyed WHERE doc_id IN (SELECT min(doc_id) FROM keyed GROUP BY k)"""


@register("batch_cleaned_deduplicated", _BATCH)
def batch_cleaned_deduplicated(spark, sf):
    return dedup.clean_batch(table(spark, sf, "documents"))


@register("exact_duplicates_dropped", f"""
    SELECT doc_id FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY {S.strip('text')})""")
def exact_duplicates_dropped(spark, sf):
    return dedup.drop_exact_duplicates(table(spark, sf, "documents")).select("doc_id")


@register("exact_duplicates_dropped_caseless", f"""
    SELECT doc_id FROM documents
    WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lower({S.strip('text')}))""")
def exact_duplicates_dropped_caseless(spark, sf):
    return dedup.drop_exact_duplicates(table(spark, sf, "documents"), lower=True).select("doc_id")


_STATS = f"""
    len(text) AS total_chars, len(replace(text, ' ', '')) AS total_chars_no_spaces, len({S.words('text')}) AS total_words,
    len({S.lines('text')}) AS total_lines, {S.count('text', r'[.!?]+')} AS total_sentences,
    {S.count('text', r'[가-힣]')} AS hangul_chars, {S.count('text', r'[a-zA-Z]')} AS latin_chars,
    {S.count('text', r'\d')} AS digits, {S.count('text', r'[.,!?;:]')} AS punctuation"""


@register("text_statistics", f"""
    SELECT *, round(hangul_chars / total_chars, 6) AS hangul_ratio, round(latin_chars / total_chars, 6) AS latin_ratio,
           round(digits / total_chars, 6) AS digit_ratio
    FROM (SELECT doc_id, {_STATS} FROM documents WHERE text <> '')""")
def text_statistics(spark, sf):
    docs = table(spark, sf, "documents").filter(F.col("text") != "")
    stats = T.text_statistics(F.col("text"))
    return docs.select(
        "doc_id", *((F.round(c, 6) if name.endswith("ratio") else c).alias(name) for name, c in stats.items())
    )


@register("text_statistics_by_language", f"""
    SELECT lang, count(*) AS documents, sum(total_chars)::BIGINT AS total_chars, sum(total_words)::BIGINT AS total_words,
           round(avg(total_lines), 6) AS avg_lines, round(sum(latin_chars) / sum(total_chars), 6) AS latin_ratio
    FROM (SELECT lang, {_STATS} FROM documents WHERE text <> '') GROUP BY lang""")
def text_statistics_by_language(spark, sf):
    stats = T.text_statistics(F.col("text"))
    docs = table(spark, sf, "documents").filter(F.col("text") != "")
    wanted = ("total_chars", "total_words", "total_lines", "latin_chars")
    return (
        docs.select("lang", *(stats[n].alias(n) for n in wanted))
        .groupBy("lang")
        .agg(
            F.count("*").alias("documents"),
            F.sum("total_chars").alias("total_chars"),
            F.sum("total_words").alias("total_words"),
            F.round(F.avg("total_lines"), 6).alias("avg_lines"),
            F.round(F.sum("latin_chars") / F.sum("total_chars"), 6).alias("latin_ratio"),
        )
    )
