"""Structure, line and sentence operators over `documents`, `pages` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import sentences as L
from corpusflow.functions import text as T
from corpusflow.functions.patterns import literal_class
from corpusflow.operators import structure
from corpusflow.plans import sql as S
from corpusflow.plans.registry import register
from corpusflow.session import table

# pages as Markdown: a fixed rewriting of their tags, the same rules on both sides
PAGE_RULES = (
    (r"(?i)<h1[^>]*>", "\n# "), (r"(?i)<h2[^>]*>", "\n## "), (r"(?i)<a href=\"([^\"]*)\">([^<]*)</a>", "[$2]($1)"),
    (r"(?i)<li[^>]*>", "\n- "), (r"(?i)<(?:p|div|br|article|nav|ul|title)[^>]*>", "\n"), (r"<[^>]+>", ""),
)


def page_markdown(spark, sf):
    text = F.col("html")
    for pattern, replacement in PAGE_RULES:
        text = T.sub(text, pattern, replacement)
    return table(spark, sf, "pages").select("page_id", text.alias("text"))


MD = f"md AS (SELECT page_id, {S.chain('html', *PAGE_RULES)} AS text FROM pages)"


def _elements(rules, source: str, key: str) -> str:
    """Positions by summing the lengths of the pieces around the matches."""
    parts = []
    for kind, pattern, flags, group, detail in rules:
        p = S.re2(pattern, flags)
        second = f"regexp_extract_all(text, '{p}', {detail})" if detail else "NULL"
        parts.append(f"""SELECT {key}, '{kind}' AS kind, {S.strip('c[i]')} AS content, {'d[i]' if detail else 'NULL::VARCHAR'} AS detail,
            (coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0)
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::BIGINT AS position
            FROM (SELECT {key}, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g,
                  regexp_extract_all(text, '{p}', {group}) AS c, {second} AS d FROM {source}), range(1, len(m) + 1) r(i)""")
    return " UNION ALL ".join(parts)


@register("markdown_elements", f"WITH {MD} {_elements(structure.MARKDOWN_ELEMENTS, 'md', 'page_id')}")
def markdown_elements(spark, sf):
    return structure.elements(page_markdown(spark, sf), structure.MARKDOWN_ELEMENTS, "page_id")


@register("structure_elements", f"WITH {MD} {_elements(structure.STRUCTURE_ELEMENTS, 'md', 'page_id')}")
def structure_elements(spark, sf):
    return structure.elements(page_markdown(spark, sf), structure.STRUCTURE_ELEMENTS, "page_id")


# --- line predicates ----------------------------------------------------------------------------------------------------------


def _incomplete(expr: str) -> str:
    bare = S.strip(expr)
    hangul = S.ends_with(bare, V.KOREAN_ENDINGS)
    return f"""CASE WHEN {bare} = '' OR {S.ends_with(bare, V.COMPLETE_ENDINGS)} THEN false
        WHEN {hangul} AND len({bare}) = 1 THEN true WHEN {hangul} AND len({bare}) > 10 THEN false
        ELSE {S.match(bare, L.INCOMPLETE)} END"""


def _joins(a: str, b: str) -> str:
    a, b = S.strip(a), S.strip(b)
    return f"""({a} <> '' AND {b} <> '' AND NOT {S.match(a, V.STRUCTURE_LINE)} AND NOT {S.match(b, V.STRUCTURE_LINE)}
        AND NOT {S.starts_with(b, V.SENTENCE_STARTERS)} AND NOT {S.match(b, L.NO_JOIN)})"""


def _mid(expr: str) -> str:
    bare = S.strip(expr)
    prose = f"(len({bare}) >= {V.MIN_PROSE_LINE} AND NOT {S.match(bare, V.STRUCTURE_LINE)} AND NOT {S.match(bare, r'[.!?\d]$')})"
    return f"(NOT {S.match(bare, r'\s\d{1,4}$')} AND ({_incomplete(expr)} OR {prose}))"


def _heading(line: str, following: str) -> str:
    capitals = f"(upper({line}) = {line} AND len({line}) < 50 AND {S.match(line, r'[A-Z]')})"
    keyword = f"({S.starts_with(line, V.HEADING_KEYWORDS)} AND len({line}) < 80 AND len({S.strip(f'coalesce({following}, {S.quote(str())})')}) > 20)"
    return f"""(len({line}) <= 100 AND NOT {S.ends_with(line, V.HEADING_STOP_ENDINGS)}
        AND ({S.match_any(line, V.HEADING_PATTERNS)} OR {capitals} OR {keyword}))"""


def _level(line: str) -> str:
    whens = " ".join(f"WHEN {S.match(line, p)} THEN {n}" for p, n in V.HEADING_LEVELS)
    return f"CASE {whens} ELSE {V.DEFAULT_HEADING_LEVEL} END"


LINES = f"""
    ls AS (SELECT doc_id, {S.lines('text')} AS l FROM documents),
    lr AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line, l[i + 1] AS following FROM ls, range(1, len(l) + 1) r(i))"""


@register("line_predicates", f"""
    WITH {LINES} SELECT doc_id, line_no, {_incomplete('line')} AS incomplete,
        coalesce({_joins('line', 'following')}, false) AS joins_next, {_mid('line')} AS mid_sentence,
        {S.strip('line')} <> '' AND NOT {S.ends_with(S.strip('line'), V.COMPLETE_ENDINGS)} AND {S.match(S.strip('line'), L.SIMPLE)} AS incomplete_simple
    FROM lr""")
def line_predicates(spark, sf):
    rows = structure.line_rows(table(spark, sf, "documents"))
    line, following = F.col("line"), F.col("following")
    return rows.select(
        "doc_id", "line_no", L.is_incomplete(line).alias("incomplete"),
        F.coalesce(L.can_join(line, following), F.lit(False)).alias("joins_next"),
        L.ends_mid_sentence(line).alias("mid_sentence"), L.is_incomplete_simple(line).alias("incomplete_simple"),
    )


@register("line_headings", f"""
    WITH {LINES} SELECT doc_id, line_no, {_heading('line', 'following')} AS heading, {_level('line')} AS level FROM lr""")
def line_headings(spark, sf):
    rows = structure.line_rows(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "line_no", L.is_heading(F.col("line"), F.col("following")).alias("heading"),
        L.heading_level(F.col("line")).alias("level"),
    )


_FIRST = S.re2(r"^(.*?[.!?])(\s.*)?$")


@register("line_first_sentences", f"""
    WITH {LINES} SELECT doc_id, line_no,
        {S.strip(f"CASE WHEN regexp_matches(line, '{_FIRST}') THEN regexp_extract(line, '{_FIRST}', 1) ELSE line END")} AS head,
        {S.strip(f"regexp_extract(line, '{_FIRST}', 2)")} AS rest FROM lr""")
def line_first_sentences(spark, sf):
    rows = structure.line_rows(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "line_no", L.sentence_head(F.col("line")).alias("head"), L.sentence_rest(F.col("line")).alias("rest")
    )


def _exploded(expr: str) -> str:
    return f"""SELECT doc_id, i - 1 AS sent_no, s[i] AS sentence FROM (SELECT doc_id, {expr} AS s FROM documents),
        range(1, len(s) + 1) r(i)"""


SENTENCES = (
    f"list_filter(list_transform(regexp_extract_all(text, '{S.re2(r'[^.!?]*[.!?]|[^.!?]+$')}'), lambda s: {S.strip('s')}), lambda s: s <> '')"
)
SPACED = f"string_split({S.sub(S.strip('text'), r'([.!?])\s+', '$1' + chr(1))}, chr(1))"


@register("sentences_by_marks", _exploded(SENTENCES))
def sentences_by_marks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", L.split_sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.posexplode("s").alias("sent_no", "sentence"))


@register("sentences_by_spaces", _exploded(SPACED))
def sentences_by_spaces(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", L.split_at_spaces(F.col("text")).alias("s"))
    return docs.select("doc_id", F.posexplode("s").alias("sent_no", "sentence"))


@register("paragraphs_split", f"""
    SELECT doc_id, i - 1 AS par_no, s[i] AS paragraph FROM (SELECT doc_id,
        list_filter(list_transform({S.lines('text')}, lambda p: {S.strip('p')}), lambda p: p <> '') AS s FROM documents), range(1, len(s) + 1) r(i)""")
def paragraphs_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", L.paragraphs(F.col("text"), "\n").alias("s"))
    return docs.select("doc_id", F.posexplode("s").alias("par_no", "paragraph"))


# --- lines to text ---------------------------------------------------------------------------------------------------------------


@register("cut_lines_connected", f"""
    WITH RECURSIVE ls AS (SELECT doc_id, list_filter(list_transform({S.lines('text')}, lambda x: {S.strip('x')}), lambda x: x <> '') AS l FROM documents),
    lr AS MATERIALIZED (SELECT doc_id, i, l[i] AS line, coalesce({_incomplete('l[i]')} AND {_joins('l[i]', 'l[i + 1]')}, false) AS edge, len(l) AS n
           FROM ls, range(1, len(l) + 1) r(i)),
    walk AS (SELECT doc_id, 1::BIGINT AS i FROM ls WHERE len(l) > 0
        UNION ALL SELECT w.doc_id, w.i + CASE WHEN lr.edge AND lr.i < lr.n THEN 2 ELSE 1 END FROM walk w JOIN lr ON lr.doc_id = w.doc_id AND lr.i = w.i
        WHERE w.i + CASE WHEN lr.edge AND lr.i < lr.n THEN 2 ELSE 1 END <= lr.n),
    heads AS (SELECT lr.doc_id, lr.i, lr.line || CASE WHEN lr.edge AND lr.i < lr.n THEN coalesce(nx.line, '') ELSE '' END AS line
        FROM walk JOIN lr ON lr.doc_id = walk.doc_id AND lr.i = walk.i LEFT JOIN lr nx ON nx.doc_id = lr.doc_id AND nx.i = lr.i + 1)
    SELECT ls.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS out FROM ls LEFT JOIN heads USING (doc_id) GROUP BY ls.doc_id""")
def cut_lines_connected(spark, sf):
    return structure.connect_cut_lines(table(spark, sf, "documents"))


_CLOSE = S.ends_with("{0}", V.SENTENCE_CLOSERS)


def _paragraphs(source: str, key: str) -> str:
    return f"""
    ps AS (SELECT {key}, list_transform({S.lines('text')}, lambda x: {S.strip('x')}) AS l FROM {source}),
    pl AS (SELECT {key}, i, l[i] AS line, CASE WHEN l[i] = '' THEN 'blank' WHEN {_heading('l[i]', 'l[i + 1]')} THEN 'heading' ELSE 'body' END AS k
           FROM ps, range(1, len(l) + 1) r(i)),
    pk AS (SELECT *, lag(k) OVER w AS pk, lag(line) OVER w AS pline FROM pl WINDOW w AS (PARTITION BY {key} ORDER BY i)),
    pg AS (SELECT *, sum(CASE WHEN pk IS NULL OR k <> 'body' OR pk <> 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM pk),
    pp AS (SELECT {key}, g, string_agg(CASE WHEN k = 'heading' THEN repeat('#', {_level('line')}) || ' ' || line
            WHEN k = 'body' AND pk = 'body' AND (pline = '' OR {_CLOSE.format('pline')}) THEN ' ' || line ELSE line END, '' ORDER BY i) AS t
           FROM pg GROUP BY {key}, g),
    para AS (SELECT {key}, string_agg(t, chr(10) ORDER BY g) AS out FROM pp GROUP BY {key})"""


@register("markdown_paragraphs", f"WITH {_paragraphs('documents', 'doc_id')} SELECT doc_id, out FROM para")
def markdown_paragraphs(spark, sf):
    return structure.markdown_paragraphs(table(spark, sf, "documents"))


_NOISE = ((r"\n\s*\n\s*\n", "\n\n"), (r"^[Pp]age\s*\d+.*$", "", "m"), (r"^\s*\d+\s*$", "", "m"), (r"^\s*-\s*\d+\s*-\s*$", "", "m"))


@register("page_text_formatted", f"""
    WITH {MD}, noise AS (SELECT page_id, {S.chain('text', *_NOISE)} AS text FROM md), {_paragraphs('noise', 'page_id')}
    SELECT page_id, {S.strip(S.sub('out', r'\n\s*\n\s*\n+', chr(10) * 2))} AS out FROM para""")
def page_text_formatted(spark, sf):
    return structure.format_page_text(page_markdown(spark, sf), "page_id")


def _title_level(par: str) -> str:
    first = f"string_split({S.strip(par)}, chr(10))[1]"
    return f"""CASE WHEN NOT {S.match_any(first, V.TITLE_PATTERNS)} THEN 0 WHEN {S.match(first, r'^\d+\.')} THEN 1
        WHEN {S.match(first, r'^[가-힣]\.')} THEN 2 ELSE 3 END"""


@register("paragraphs_titled", f"""
    SELECT doc_id, {S.sub(f'''array_to_string(list_transform(list_filter({S.lines('text')}, lambda p: {S.strip('p')} <> ''),
        lambda p: CASE WHEN {_title_level('p')} > 0 THEN repeat('#', {_title_level('p')}) || ' ' || {S.strip('p')} ELSE p END), chr(10)||chr(10))''', r'\n{3,}', chr(10) * 2)} AS out
    FROM documents""")
def paragraphs_titled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", structure.structured_text(F.col("text"), "\n").alias("out"))


@register("pages_joined")
def pages_joined(spark, sf):
    """Lines of a document as its pages: cut sentences are completed from the next page."""
    docs = table(spark, sf, "documents").select("doc_id", structure.join_pages(T.lines(F.col("text"))).alias("p"))
    return docs.select("doc_id", F.posexplode("p").alias("page", "text"))


# --- pages, layout, images -----------------------------------------------------------------------------------------------------------

# lines of a document as layout elements; the category follows from the line itself
CATEGORY = "CASE WHEN length(line) < 30 THEN 'header' WHEN contains(line, '|') THEN 'table' WHEN contains(line, '@') THEN 'footer' ELSE 'paragraph' END"

# for what does not drop headers and footers: every line stays
KEPT_CATEGORY = "CASE WHEN contains(line, '|') THEN 'table' ELSE 'paragraph' END"


def layout_elements(spark, sf, category=CATEGORY):
    rows = structure.line_rows(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", F.col("line_no").alias("seq"), (F.floor(F.col("line_no") / 20) * 2).cast("int").alias("batch_start"),
        (F.floor(F.col("line_no") / 10) % 2 + 1).cast("int").alias("page"), F.expr(category).alias("category"),
        F.col("line").alias("markdown"),
    )


def _layout(category: str) -> str:
    return f"""{LINES},
    lay AS (SELECT doc_id, line_no AS seq, ((line_no // 20) * 2 + (line_no // 10) % 2 + 1)::INT AS page, line AS markdown, {category} AS category FROM lr),
    pg AS (SELECT doc_id, page, string_agg(markdown, chr(10)||chr(10) ORDER BY seq) AS text FROM lay
           WHERE category NOT IN ('header', 'footer') GROUP BY ALL)"""


LAYOUT = _layout(KEPT_CATEGORY)


def layout_pages(spark, sf, category=KEPT_CATEGORY):
    return structure.assemble_pages(layout_elements(spark, sf, category))


@register("layout_pages", f"WITH {_layout(CATEGORY)} SELECT doc_id, page, text FROM pg")
def layout_pages_query(spark, sf):
    return layout_pages(spark, sf, CATEGORY)


@register("pages_marked", f"""WITH {LAYOUT} SELECT doc_id, string_agg('[페이지 ' || page || ']' || chr(10) || text, chr(10)||chr(10) ORDER BY page) AS out
    FROM pg WHERE {S.strip('text')} <> '' GROUP BY doc_id""")
def pages_marked(spark, sf):
    return structure.mark_pages(layout_pages(spark, sf))


@register("text_layer", f"""WITH {LAYOUT} SELECT doc_id, count(*) AS pages,
    sum(len({S.strip('text')})) >= 50 * greatest(count(*), 1) AS has_text FROM pg GROUP BY doc_id""")
def text_layer(spark, sf):
    return structure.has_text_layer(layout_pages(spark, sf))


# every line with a noise mark is an image of its page: name from its place, size and relevance from its length
def image_rows(spark, sf):
    rows = layout_elements(spark, sf, KEPT_CATEGORY).filter(F.col("markdown").contains("#") | F.col("markdown").contains("|"))
    page = (F.col("batch_start") + F.col("page")).cast("int")
    name = F.format_string("doc%d_page%d_img%d.png", "doc_id", page, "seq")
    size = F.length("markdown")
    return rows.select(
        "doc_id", page.alias("page"), "seq", F.concat(F.lit("images/"), name).alias("path"), name.alias("filename"),
        F.when(F.col("category") == "table", F.lit("table")).alias("description"),
        size.alias("width"), (size / 2).cast("int").alias("height"), F.round(1 / (1 + size / 200), 6).alias("relevance"),
    )


IMAGES = f"""{LAYOUT},
    img AS (SELECT doc_id, page, seq, 'images/' || f AS path, f AS filename, CASE WHEN category = 'table' THEN 'table' END AS description,
        n AS width, n // 2 AS height, round(1 / (1 + n / 200), 6) AS relevance
        FROM (SELECT *, 'doc' || doc_id || '_page' || page || '_img' || seq || '.png' AS f, len(markdown) AS n FROM lay
              WHERE contains(markdown, '#') OR contains(markdown, '|')))"""


@register("page_image_blocks", f"""
    WITH {IMAGES},
    ib AS (SELECT doc_id, page, string_agg(chr(10) || '![이미지](' || path || ')' || chr(10) || CASE WHEN coalesce(description, '') <> ''
        THEN '**이미지 설명**: ' || description || chr(10) ELSE '**이미지**: 페이지 ' || page || '의 이미지 ' || path || chr(10) END, '' ORDER BY seq) AS images
        FROM img GROUP BY ALL)
    SELECT doc_id, page, '[페이지 ' || page || ']' || chr(10) || text || CASE WHEN images IS NULL THEN ''
        ELSE chr(10)||chr(10) || '### 페이지 내 이미지' || chr(10) || images END AS out FROM pg LEFT JOIN ib USING (doc_id, page)""")
def page_image_blocks(spark, sf):
    return structure.image_blocks(layout_pages(spark, sf), image_rows(spark, sf))


IMAGES_PLACED = f"""{IMAGES},
    mt AS (SELECT doc_id, string_agg(CASE WHEN page % 3 = 0 THEN text ELSE '<!-- 페이지 ' || page || ' 시작 -->' || chr(10) || text END, chr(10) ORDER BY page) AS text FROM pg GROUP BY doc_id),
    il AS MATERIALIZED (SELECT doc_id, i, {S.strip('l[i]')} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM mt WHERE {S.strip('text')} <> ''), range(1, len(l) + 1) r(i)),
    im AS (SELECT *, starts_with(line, '<!-- 페이지 ') AND ends_with(line, ' 시작 -->') AS marked FROM il),
    ic AS (SELECT doc_id, page, count(*) AS n FROM img GROUP BY ALL),
    sp AS (SELECT doc_id, i, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
        FROM (SELECT *, regexp_extract(line, '페이지 ([0-9]+)', 1)::INT AS page FROM im WHERE marked) JOIN ic USING (doc_id, page)),
    pl2 AS (SELECT doc_id, i, first + k AS no FROM sp, range(100000) r(k) WHERE k < n),
    pi AS (SELECT * FROM (SELECT doc_id, '![이미지](' || path || ')' AS ref, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) - 1 AS no FROM img) LEFT JOIN pl2 USING (doc_id, no) WHERE doc_id IN (SELECT doc_id FROM il)),
    every AS (SELECT doc_id, i, 0 AS kind, 0 AS no, line AS v FROM im WHERE NOT marked UNION ALL SELECT doc_id, coalesce(i, 1000000000), CASE WHEN i IS NULL THEN 3 ELSE 1 END, no, CASE WHEN i IS NULL THEN ref ELSE chr(10) || ref || chr(10) END FROM pi
        UNION ALL SELECT DISTINCT doc_id, 1000000000, 2, 0, chr(10) || chr(10) || '## 추가 이미지' || chr(10) FROM pi WHERE i IS NULL),
    ip AS (SELECT doc_id, string_agg(v, chr(10) ORDER BY i, kind, no) AS text FROM every GROUP BY doc_id)"""


def marked_texts(spark, sf):
    """Pages under markers; every third page has none, so that its images are left over."""
    line = F.when(F.col("page") % 3 == 0, F.col("text")).otherwise(F.concat(F.format_string("<!-- 페이지 %d 시작 -->\n", "page"), "text"))
    return structure.ordered_text(layout_pages(spark, sf), ["doc_id"], "page", line, "\n", "text")


def references(spark, sf):
    return image_rows(spark, sf).select("doc_id", "page", "seq", F.format_string("![이미지](%s)", "path").alias("reference"))


@register("images_placed", f"WITH {IMAGES_PLACED} SELECT doc_id, text AS out FROM ip")
def images_placed(spark, sf):
    return structure.place_images(marked_texts(spark, sf), references(spark, sf))


@register("page_text_with_images", f"""
    WITH src AS (WITH {IMAGES_PLACED} SELECT doc_id, text FROM ip), noise AS (SELECT doc_id, {S.chain('text', *_NOISE)} AS text FROM src), {_paragraphs('noise', 'doc_id')}
    SELECT doc_id, {S.strip(S.sub('out', r'\n\s*\n\s*\n+', chr(10) * 2))} AS out FROM para""")
def page_text_with_images(spark, sf):
    return structure.format_page_text_with_images(marked_texts(spark, sf), references(spark, sf))


@register("images_kept", f"""
    WITH {IMAGES} SELECT count(*) AS found, count(*) FILTER (kept) AS kept, count(*) FILTER (description IS NOT NULL) AS with_text
    FROM (SELECT *, width >= 50 AND height >= 50 AND relevance >= 0.6 AS kept FROM img)""")
def images_kept(spark, sf):
    kept = structure.keep_images(image_rows(spark, sf))
    return kept.agg(
        F.count("*").alias("found"), F.count_if("kept").alias("kept"), F.count("description").alias("with_text")
    )


@register("image_file_pages", f"""WITH {IMAGES} SELECT filename, try_cast(regexp_extract(filename, '_page(\\d+)_img(\\d+)', 1) AS INT) AS page FROM img""")
def image_file_pages(spark, sf):
    return image_rows(spark, sf).select("filename", structure.image_file_page(F.col("filename")).alias("page"))


@register("response_images", f"""
    WITH {IMAGES}, first AS (SELECT doc_id, path, min(seq) AS seq FROM img GROUP BY ALL)
    SELECT doc_id, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, path) AS rank FROM first) WHERE rank <= 4""")
def response_images(spark, sf):
    """Image references of a document: union of its lists, first seen per path, at most four per response."""
    rows = image_rows(spark, sf)
    listed = rows.select("doc_id", "seq", F.explode(F.array("path", F.concat(F.lit("images/"), "filename"))).alias("path"))
    return structure.first_images(listed)


@register("labelled_output_parsed", f"""
    WITH x AS (SELECT conv_id, turn, 'RELEVANCE: ' || (len(text) / 1000.0)::DECIMAL(10,3) || chr(10) || 'DESCRIPTION: ' || role || chr(10) || 'TEXT: ' || text AS o FROM conversations)
    SELECT conv_id, turn, round(coalesce(try_cast({S.strip("regexp_extract(o, '(?im)^[ ]*relevance:(.*)$', 1)")} AS DOUBLE), 0), 6) AS relevance,
        {S.strip("regexp_extract(o, '(?im)^[ ]*description:(.*)$', 1)")} AS description,
        {S.strip("regexp_extract(o, '(?im)^[ ]*text:(.*)$', 1)")} AS extracted_text FROM x""")
def labelled_output_parsed(spark, sf):
    output = F.concat(
        F.lit("RELEVANCE: "), (F.length("text") / 1000).cast("decimal(10,3)").cast("string"), F.lit("\nDESCRIPTION: "), "role", F.lit("\nTEXT: "), "text"
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", output.alias("o"))
    fields = structure.parse_labelled(F.col("o"))
    return rows.select("conv_id", "turn", *(c.alias(n) for n, c in fields.items()))


@register("extraction_summary", f"""
    WITH {IMAGES} SELECT doc_id, count(*) AS total_images, count(*) FILTER (relevance >= 0.6) AS relevant_images,
        coalesce(string_agg(filename, ',' ORDER BY seq) FILTER (relevance >= 0.6), '') AS saved,
        coalesce(string_agg(description, chr(10)||chr(10) ORDER BY seq), '') AS texts FROM img GROUP BY doc_id""")
def extraction_summary(spark, sf):
    return structure.extraction_summary(image_rows(spark, sf))


# --- answers -----------------------------------------------------------------------------------------------------------------------------

KIND = "CASE WHEN starts_with({0}, 'The ') THEN 'summary' WHEN starts_with({0}, 'Of ') THEN 'details' WHEN starts_with({0}, 'And ') THEN 'references' END"


@register("sections_split", f"""
    WITH ls AS (SELECT doc_id, {S.lines('text')} AS l FROM documents),
    lr AS (SELECT doc_id, i, l[i] AS line, {KIND.format('l[i]')} AS k FROM ls, range(1, len(l) + 1) r(i)),
    g AS (SELECT *, sum((k IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lr),
    s AS (SELECT doc_id, g, max(k) AS kind, {S.strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (k IS NULL), '')")} AS body FROM g GROUP BY doc_id, g),
    m AS (SELECT s.doc_id, s.g, s.kind, CASE WHEN s.g = 1 AND coalesce(p.body, '') <> '' THEN {S.strip("p.body || chr(10)||chr(10) || s.body")} ELSE s.body END AS body
          FROM s LEFT JOIN s p ON p.doc_id = s.doc_id AND p.g = 0 WHERE s.g > 0)
    SELECT doc_id, g - 1 AS section_no, kind, body FROM m
    UNION ALL SELECT doc_id, 0, 'other', body FROM s WHERE g = 0 AND body <> '' AND doc_id NOT IN (SELECT doc_id FROM m)""")
def sections_split(spark, sf):
    """Sections of the documents, with three frequent line starts standing in for the section names."""

    def kind(line):
        return (
            F.when(line.startswith("The "), "summary").when(line.startswith("Of "), "details").when(line.startswith("And "), "references")
        )

    return structure.answer_sections(table(spark, sf, "documents"), kind=kind)


@register("answers_formatted")
def answers_formatted(spark, sf):
    turns = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return structure.format_answers(turns.withColumn("query_id", F.col("conv_id") * 100 + F.col("turn")))
