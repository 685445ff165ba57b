"""Structure of texts: Markdown elements, headings, paragraphs, sections, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import folds
from corpusflow.functions import sentences as L
from corpusflow.functions import text as T
from corpusflow.functions.patterns import java

MARKDOWN_ELEMENTS = (
    ("header", r"^(#{1,6})\s*(.+?)$", "m", 2, 1),
    ("code_block", r"```[\s\S]*?```", "m", 0, None),
    ("link", r"\[([^\]]+)\]\(([^)]+)\)", "", 1, 2),
    ("image", r"!\[([^\]]*)\]\(([^)]+)\)", "", 1, 2),
    ("unordered", r"^\s*[-*+]\s+(.+)$", "m", 1, None),
    ("ordered", r"^\s*\d+\.\s+(.+)$", "m", 1, None),
    ("table", r"^\|.*\|$", "m", 0, None),
)
STRUCTURE_ELEMENTS = (
    ("section", r"^(제?\s*\d+\s*[장절편부].*?)$", "m", 1, None),
    ("subsection", r"^(\d+\.\d+.*?)$", "m", 1, None),
    ("numbered", r"^\s*(\d+)\.\s*(.+)$", "m", 2, 1),
    ("bulleted", r"^\s*[•·▪▫-]\s*(.+)$", "m", 1, None),
    ("table", r"^\s*\|.*\|\s*$", "m", 0, None),
    ("citation", r"\[[^\]]+\]\s*$", "m", 0, None),
    ("reference", r"(?i)^참고\s*[:：]|^출처\s*[:：]|^Reference\s*:", "m", 0, None),
)


def elements(docs: DataFrame, rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, content, detail, position) of every match of every rule.

    Positions come from the lengths of the pieces around the matches, so the text is split once per rule and neither
    exploded into lines nor shuffled.
    """
    out = None
    for kind, pattern, flags, group, detail in rules:
        spelled = java(pattern, flags)
        found = docs.select(
            key,
            F.regexp_extract_all(text, F.lit(spelled), F.lit(0)).alias("m"),
            F.split(text, spelled, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(spelled), F.lit(group)).alias("c"),
            *([F.regexp_extract_all(text, F.lit(spelled), F.lit(detail)).alias("d")] if detail else []),
        ).filter(F.size("m") > 0)
        steps = F.zip_with("m", F.slice("gaps", F.lit(1), F.size("m")), lambda m, gap: F.length(gap) + F.length(m))
        placed = found.withColumn("ends", folds.running_total(steps))
        rows = placed.select(
            key,
            F.explode(
                F.transform(
                    "m",
                    lambda m, i: F.struct(
                        T.strip(F.get("c", i)).alias("content"),
                        (F.get("d", i) if detail else F.lit(None).cast("string")).alias("detail"),
                        (F.get("ends", i) - F.length(m)).alias("position"),
                    ),
                )
            ).alias("e"),
        ).select(key, F.lit(kind).alias("kind"), "e.content", "e.detail", "e.position")
        out = rows if out is None else out.unionByName(rows)
    return out


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, following): each line with the one after it, taken inside the row."""
    paired = docs.select(key, T.lines(F.col(text)).alias("l")).select(
        key, F.posexplode(F.transform("l", lambda x, i: F.struct(x.alias("line"), F.get("l", i + 1).alias("following"))))
    )
    return paired.select(key, F.col("pos").alias("line_no"), "col.line", "col.following")


def connect_cut_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", joiner: str = "") -> DataFrame:
    rows = F.filter(F.transform(T.lines(F.col(text)), T.strip), lambda line: line != "")
    listed = docs.select(key, rows.alias("l"))
    edges = F.transform(
        "l", lambda line, i: F.coalesce(L.is_incomplete(line) & L.can_join(line, F.get("l", i + 1)), F.lit(False))
    )
    paired = listed.withColumn("g", folds.pair_up(edges))
    return paired.select(key, T.join(folds.assemble(F.col("l"), F.col("g"), joiner)).alias("out"))


def markdown_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines as Markdown: blank lines and headings break paragraphs; a space joins only after a complete sentence."""
    listed = docs.select(key, F.transform(T.lines(F.col(text)), T.strip).alias("l"))
    kinds = F.transform(
        "l",
        lambda line, i: F.when(line == "", "blank")
        .when(L.is_heading(line, F.get("l", i + 1)), "heading")
        .otherwise("body"),
    )
    marked = listed.withColumn("k", kinds)
    starts = F.transform("k", lambda k, i: (i == 0) | (k != "body") | (F.get("k", i - 1) != "body"))
    grouped = marked.withColumn("g", folds.segments(starts))

    def piece(i: Column, at: Column) -> Column:
        line = F.get("l", i)
        previous = F.get("l", i - 1)
        gap = F.when((at > 0) & L.ends_complete(previous), " ").otherwise("")
        hashes = F.repeat(F.lit("#"), L.heading_level(line))
        return F.when(F.get("k", i) == "heading", F.concat(hashes, F.lit(" "), line)).otherwise(F.concat(gap, line))

    built = F.transform("g", lambda g: F.array_join(F.transform(g, piece), ""))
    return grouped.select(key, T.join(built).alias("out"))


def format_page_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Noise lines out, lines to paragraphs, runs of blank lines to one."""
    stripped = docs.select(key, T.strip_noise_lines(F.col(text)).alias("_t"))
    built = markdown_paragraphs(stripped, key, "_t")
    return built.select(key, T.strip(T.sub(F.col("out"), r"\n\s*\n\s*\n+", "\n\n")).alias("out"))


def place_images(docs: DataFrame, images: DataFrame, key: str = "doc_id", text: str = "text", start: str = "<!-- 페이지 ", end: str = " 시작 -->") -> DataFrame:
    """(key, out): the page markers of a text replaced by the images of their pages; images that are left under a heading.

    `images` has (key, page, seq, reference). They are taken in the order of pages: a marker of a page with n images takes
    the next n. Text lines and images are two ordered streams that meet by position; every line and image moves once.
    """
    lines = docs.filter(T.strip(F.col(text)) != "").select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select(key, "pos", T.strip(F.col("line")).alias("line"))
    marked = F.col("line").startswith(start) & F.col("line").endswith(end)
    number = F.when(marked, F.expr("try_cast(regexp_extract(line, '페이지 ([0-9]+)', 1) as int)"))
    counts = images.groupBy(key, "page").agg(F.count(F.lit(1)).alias("n"))
    spots = lines.withColumn("page", number).filter("page is not null").join(counts, [key, "page"])
    before = F.sum("n").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))  # markers of one text
    spots = spots.withColumn("first", F.coalesce(before, F.lit(0))).select(key, "pos", F.explode(F.expr("sequence(first, first + n - 1)")).alias("no"))
    order = Window.partitionBy(key).orderBy("page", "seq")  # images of one text
    placed = images.withColumn("no", F.row_number().over(order) - 1).join(spots, [key, "no"], "left").join(lines.select(key).distinct(), key, "left_semi")
    inside = F.col("pos").isNotNull()
    shown = placed.select(key, F.struct(F.coalesce("pos", F.lit(2**31 - 1)).alias("pos"), F.when(inside, 1).otherwise(3).alias("kind"), F.col("no").cast("long").alias("no")).alias("at"),
                          F.when(inside, F.concat(F.lit("\n"), "reference", F.lit("\n"))).otherwise(F.col("reference")).alias("v"))
    heading = placed.filter(~inside).select(key).distinct()
    titled = heading.select(key, F.struct(F.lit(2**31 - 1).alias("pos"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("no")).alias("at"), F.lit("\n\n## 추가 이미지\n").alias("v"))
    kept = lines.filter(~marked).select(key, F.struct("pos", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("no")).alias("at"), F.col("line").alias("v"))
    return ordered_text(kept.unionByName(shown).unionByName(titled), [key], "at", F.col("v"), "\n", "out")


def format_page_text_with_images(docs: DataFrame, images: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The text with its images in place, then formatted as `format_page_text` does."""
    return format_page_text(place_images(docs, images, key, text), key, "out")


def titled_paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Paragraphs whose first line is a title get that many `#`."""
    parts = F.filter(F.split(text, java(separator)), lambda p: T.strip(p) != "")
    level = L.paragraph_title_level
    return T.join(
        F.transform(
            parts,
            lambda p: F.when(level(p) > 0, F.concat(F.repeat(F.lit("#"), level(p)), F.lit(" "), T.strip(p))).otherwise(p),
        ),
        "\n\n",
    )


def structured_text(text: Column, separator: str = "\n\n") -> Column:
    return T.collapse_blank_lines(titled_paragraphs(T.fix_headings(text), separator))


PAGES_AT_ONCE = 64


def join_pages(pages: Column, max_lines: int = V.MAX_CARRIED_LINES) -> Column:
    """Sentences cut at a page end finished with up to three lines of the next page; the number of pages stays.

    A fold over the pages of one row: the state is the finished pages and the page being completed, and a page is
    examined only after it has given its first lines away.  Finished pages are kept in parts of PAGES_AT_ONCE, so that a
    page copies the few of its own part and not all before it.
    """
    trimmed = F.transform(pages, lambda p: T.sub(T.sub(p, r"^\n+"), r"\s+$"))

    def carry(state: Column) -> Column:
        """One move of a sentence rest from `nxt` to `cur`; `nxt` is null once no line is left."""
        last = F.substring_index(state["cur"], "\n", -1)
        first = F.substring_index(state["nxt"], "\n", 1)
        others = F.substring(state["nxt"], F.length(first) + 2, F.length(state["nxt"]))
        rest = L.sentence_rest(first)
        more = state["nxt"].contains("\n")
        remaining = (
            F.when((rest != "") & (F.length(first) < F.length(state["nxt"])), F.concat(rest, F.lit("\n"), others))
            .when(rest != "", rest)
            .when(more, others)
        )
        moved = F.concat(T.sub(state["cur"], r"[^\S\n]+$"), F.lit(" "), L.sentence_head(first))
        able = F.coalesce(
            state["open"]
            & state["nxt"].isNotNull()
            & (T.strip(last) != "")
            & L.ends_mid_sentence(last)
            & L.can_join(last, first),
            F.lit(False),
        )
        return F.when(able, F.struct(moved.alias("cur"), remaining.alias("nxt"), F.lit(True).alias("open"))).otherwise(
            F.struct(state["cur"].alias("cur"), state["nxt"].alias("nxt"), F.lit(False).alias("open"))
        )

    def step(acc: Column, page: Column) -> Column:
        state = F.struct(acc["cur"].alias("cur"), page.alias("nxt"), F.lit(True).alias("open"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(max_lines)), state, lambda s, _: carry(s))
        full = F.size(acc["part"]) >= PAGES_AT_ONCE
        return T.let(
            done,
            lambda s: F.struct(
                F.when(full, F.concat(acc["out"], F.array(acc["part"]))).otherwise(acc["out"]).alias("out"),
                F.when(full, F.array(s["cur"])).otherwise(F.concat(acc["part"], F.array(s["cur"]))).alias("part"),
                T.sub(F.coalesce(s["nxt"], F.lit("")), r"^\n+|\n+$").alias("cur"),
            ),
        )

    def joined(ps: Column) -> Column:
        start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("part"), F.get(ps, F.lit(0)).alias("cur"))
        return F.aggregate(
            F.slice(ps, F.lit(2), F.greatest(F.size(ps) - 1, F.lit(0))), start, step,
            lambda acc: F.concat(F.flatten(acc["out"]), acc["part"], F.array(acc["cur"])),
        )

    return F.when(F.size(pages) == 0, pages).otherwise(T.let(trimmed, joined))


# --- pages, images, loads -------------------------------------------------------------------------------------------------------


def has_text_layer(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pages, has_text): the pages hold on average at least fifty stripped characters."""
    return pages.groupBy(key).agg(
        F.count("*").alias("pages"),
        (F.sum(F.length(T.strip(F.col(text)))) >= V.TEXT_LAYER_CHARS_PER_PAGE * F.greatest(F.count("*"), F.lit(1))).alias(
            "has_text"
        ),
    )


def ordered_text(rows: DataFrame, keys: list[str], order: str, value: Column, separator: str, name: str) -> DataFrame:
    """One text per key from its rows in order.  Only for keys whose rows together are one document."""
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("s"))
    return gathered.select(*keys, F.array_join(F.transform("s", lambda s: s["v"]), separator).alias(name))


def assemble_pages(layout: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, text) from layout elements (batch_start, page, seq, category, markdown); headers and footers go."""
    body = layout.filter(~F.col("category").isin("header", "footer")).withColumn("page", F.col("batch_start") + F.col("page"))
    return ordered_text(body, [key, "page"], "seq", F.col("markdown"), "\n\n", "text")


def mark_pages(pages: DataFrame, key: str = "doc_id", template: str = "[페이지 %d]\n%s") -> DataFrame:
    """Page texts under numbered markers; blank pages are skipped."""
    filled = pages.filter(T.strip(F.col("text")) != "")
    return ordered_text(filled, [key], "page", F.format_string(template, "page", "text"), "\n\n", "out")


def image_blocks(pages: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, out): page text under its marker, then its images with a caption or a fallback caption."""
    caption = F.when(
        F.coalesce("description", F.lit("")) != "", F.format_string("**이미지 설명**: %s\n", "description")
    ).otherwise(F.format_string("**이미지**: 페이지 %d의 이미지 %s\n", "page", "path"))
    one = F.concat(F.format_string("\n![이미지](%s)\n", "path"), caption)
    listed = ordered_text(images, [key, "page"], "seq", one, "", "images")
    block = F.format_string("[페이지 %d]\n%s", "page", "text")
    return pages.join(listed, [key, "page"], "left").select(
        key, "page",
        F.when(F.col("images").isNull(), block).otherwise(F.concat(block, F.lit("\n\n### 페이지 내 이미지\n"), "images")).alias("out"),
    )


def keep_images(images: DataFrame, threshold: float = 0.6, min_size: int = 50) -> DataFrame:
    """Relevance and size filters as a flag, so that counts of found and kept images come from one pass."""
    big = (F.col("width") >= min_size) & (F.col("height") >= min_size)
    return images.withColumn("kept", big & (F.col("relevance") >= threshold))


def parse_labelled(text: Column) -> dict[str, Column]:
    """Fields of a labelled model output; an unreadable relevance counts as 0."""

    def field(label: str) -> Column:
        return T.strip(F.regexp_extract(text, java(rf"(?i)^\s*{label}:(.*)$", "m"), 1))

    return {
        "relevance": F.coalesce(field("relevance").try_cast("double"), F.lit(0.0)),
        "description": field("description"),
        "extracted_text": field("text"),
    }


def image_file_page(name: Column) -> Column:
    return F.regexp_extract(name, r"_page(\d+)_img(\d+)", 1).try_cast("int")


# --- answers: sections -------------------------------------------------------------------------------------------------------------


def section_kind(line: Column) -> Column:
    """summary, details or references when the line is a section heading, else null."""
    name = F.lower(T.sub(T.strip(T.sub(T.strip(line), r"^[#*>\-\d.\s]+")), r":+$"))
    out = F
    for kind, aliases in V.SECTION_ALIASES.items():
        out = out.when(name.isin(*aliases), kind)
    return out.otherwise(F.lit(None))


def answer_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", kind=section_kind) -> DataFrame:
    """(key, section_no, kind, body): a text cut at its section headings.

    Text before the first heading joins the first section; a text without headings is one section of kind `other`.
    """
    listed = docs.select(key, T.lines(F.col(text)).alias("l")).withColumn("k", F.transform("l", kind))
    starts = F.transform("k", lambda k: k.isNotNull())
    grouped = listed.withColumn("g", folds.segments(starts))

    def section(g: Column) -> Column:
        first = F.get("k", F.get(g, F.lit(0)))
        body = F.when(first.isNull(), g).otherwise(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))))
        return F.struct(
            first.alias("kind"), T.strip(F.array_join(F.transform(body, lambda i: F.get("l", i)), "\n")).alias("body")
        )

    cut = grouped.select(key, F.transform("g", section).alias("s"))
    lead = F.get("s", F.lit(0))

    def merged(s: Column, i: Column) -> Column:
        joined = T.strip(F.concat_ws("\n\n", F.nullif(lead["body"], F.lit("")), s["body"]))
        return F.struct(s["kind"].alias("kind"), F.when((i == 0) & lead["kind"].isNull(), joined).otherwise(s["body"]).alias("body"))

    rest = F.transform(F.filter("s", lambda s: s["kind"].isNotNull()), merged)
    whole = F.array(F.struct(F.lit("other").alias("kind"), lead["body"].alias("body")))
    return (
        cut.select(key, F.posexplode(F.when(F.size(rest) > 0, rest).otherwise(whole)))
        .select(key, F.col("pos").alias("section_no"), "col.kind", "col.body")
        .filter((F.col("kind") != "other") | (F.col("body") != ""))
    )


def reference_block(sources: DataFrame, query_key: str = "query_id") -> DataFrame:
    """One bullet per source, numbered by its rank; sources of one query are at most k."""
    relevance = F.when(F.col("relevance_score") != 0, F.format_string("관련도 %.1f%%", "relevance_score"))
    page = F.when(F.coalesce("page", F.lit("N/A")) != "N/A", F.concat(F.lit("p."), "page"))
    details = F.concat_ws(", ", relevance, page, F.nullif("chunk_id", F.lit("")))
    name = F.coalesce(F.nullif("file_name", F.lit("")), F.nullif("source", F.lit("")), F.lit("출처 미상"))
    line = F.concat(
        F.format_string("- [출처 %d] ", "index"), name,
        F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""),
    )
    return ordered_text(sources, [query_key], "index", line, "\n", "references")


def format_answers(answers: DataFrame, references: DataFrame | None = None, key: str = "query_id", text: str = "text") -> DataFrame:
    """Answers laid out as summary, details, references; missing sections are filled, error messages pass through."""
    listed = answers.select(key, F.col(text).alias("_raw"), T.lines(T.strip(F.col(text))).alias("l"))
    listed = listed.withColumn("k", F.transform("l", section_kind)).withColumn("g", folds.segments(F.transform("k", lambda k: k.isNotNull())))

    def body(g: Column, skip: int) -> Column:
        picked = F.slice(g, F.lit(1 + skip), F.greatest(F.size(g) - skip, F.lit(0)))
        return F.array_join(F.transform(picked, lambda i: F.get("l", i)), "\n")

    def kind_of(g: Column) -> Column:
        return F.get("k", F.get(g, F.lit(0)))

    def section(kind: str) -> Column:
        found = F.filter("g", lambda g: kind_of(g) == kind)
        last = F.get(found, F.size(found) - 1)  # a later section of one kind replaces an earlier one
        return F.coalesce(T.collapse_blank_lines(T.strip(body(last, 1))), F.lit(""))

    lead = F.get(F.filter("g", lambda g: kind_of(g).isNull()), F.lit(0))
    loose = L.paragraphs(F.coalesce(body(lead, 0), F.lit("")), r"\n\s*\n")
    parts = listed.select(key, "_raw", *(section(k).alias(k) for k, _ in V.SECTION_ORDER), loose.alias("p"))
    if references is None:
        parts = parts.withColumn("_r", F.lit(""))
    else:
        sources = references.select(key, F.col("references").alias("_r"))
        parts = parts.join(sources, key, "left").withColumn("_r", F.coalesce("_r", F.lit("")))
    first = F.coalesce(F.get("p", F.lit(0)), F.lit(""))
    used = F.when((F.col("summary") == "") & (F.size("p") > 0), 1).otherwise(0)
    remaining = F.slice("p", used + 1, F.greatest(F.size("p") - used, F.lit(0)))
    filled = {
        "summary": F.when(F.col("summary") == "", first).otherwise(F.col("summary")),
        "details": F.when(F.col("details") == "", T.join(remaining, "\n\n")).otherwise(F.col("details")),
        "references": F.when(F.col("references") == "", F.col("_r")).otherwise(
            T.strip(F.concat(F.col("references"), F.lit("\n"), F.col("_r")))
        ),
    }
    blocks = [
        F.concat(
            F.lit(f"### {title}\n"),
            F.coalesce(F.nullif(T.normalize_lists(filled[kind]), F.lit("")), F.lit(V.SECTION_PLACEHOLDERS[kind])),
        )
        for kind, title in V.SECTION_ORDER
    ]
    laid_out = F.concat_ws("\n\n", *blocks)
    raw = F.col("_raw")
    return parts.select(
        key,
        F.when(T.strip(raw) == "", raw).when(T.is_error_message(T.strip(raw)), T.strip(raw)).otherwise(laid_out).alias("out"),
    )


def first_images(references: DataFrame, key: str = "doc_id", limit: int = 4) -> DataFrame:
    """(key, path, rank): distinct paths in first-seen order, at most `limit` per response (a display limit)."""
    first = references.groupBy(key, "path").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("seq", "path")))
    return ranked.filter(F.col("rank") <= limit).select(key, "path", "rank")


def extraction_summary(images: DataFrame, key: str = "doc_id", threshold: float = 0.6) -> DataFrame:
    """Per document: counts, saved file names and extracted texts in order."""
    saved = F.col("relevance") >= threshold
    rows = images.groupBy(key).agg(
        F.count("*").alias("total_images"),
        F.count_if(saved).alias("relevant_images"),
        F.sort_array(F.collect_list(F.struct("seq", "filename", saved.alias("saved"), "description"))).alias("r"),
    )
    return rows.select(
        key, "total_images", "relevant_images",
        T.join(F.transform(F.filter("r", lambda r: r["saved"]), lambda r: r["filename"]), ",").alias("saved"),
        T.join(F.transform(F.filter("r", lambda r: r["description"].isNotNull()), lambda r: r["description"]), "\n\n").alias("texts"),
    )
