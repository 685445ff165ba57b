"""Text cleaning as column expressions: every function stays inside the JVM and inside one row, so nothing shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions.patterns import WHITESPACE_CHARS, java, literal_class


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(text: Column, pattern: str, replacement: str = "", flags: str = "") -> Column:
    return F.regexp_replace(text, F.lit(java(pattern, flags)), F.lit(replacement))


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(java(pattern, flags))


def matches_any(text: Column, patterns: Iterable[str], flags: str = "") -> Column:
    result = F.lit(False)
    for pattern in patterns:
        result = result | matches(text, pattern, flags)
    return result


def count_matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(java(pattern, flags)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def split_words(text: Column) -> Column:
    """Words between runs of whitespace; an empty array for blank text."""
    return F.filter(F.split(text, java(r"\s+")), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def join(parts: Column, separator: str = "\n") -> Column:
    return F.array_join(parts, separator)


def ends_with_any(text: Column, endings: Iterable[str]) -> Column:
    return text.rlike(literal_class(endings) + "\\z")


def starts_with_any(text: Column, starts: Iterable[str]) -> Column:
    return text.rlike("\\A" + literal_class(starts))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | text.contains(word)
    return result


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many different words of the list occur in the text."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def translate(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def words_in(words: Column, members: Iterable[str]) -> Column:
    return words.isin(*members)


# --- documents and pages ---------------------------------------------------------------------------------------------


def is_junk_line(line: Column, patterns: Iterable[str] = V.JUNK_LINES) -> Column:
    return let(strip(line), lambda bare: matches_any(bare, patterns))


def drop_junk_lines(text: Column) -> Column:
    """Image links become their alt text (nothing for a placeholder), model tokens and junk lines go."""
    text = sub(text, V.PLACEHOLDER_IMAGE)
    text = sub(text, V.MARKDOWN_IMAGE, "$1")
    text = sub(text, V.MODEL_BOX_TOKEN)
    return join(F.filter(lines(text), lambda line: ~is_junk_line(line)))


def _plain_spaces(text: Column) -> Column:
    """Wide spaces become plain ones; zero-width space and byte order mark go."""
    return F.translate(text, "\xa0\u3000\u200b\ufeff", "  ")


def _no_zero_width(text: Column) -> Column:
    return F.translate(text, "\u200b\ufeff", "")


def _no_controls(text: Column) -> Column:
    return sub(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def clean_general(text: Column) -> Column:
    text = _plain_spaces(text)
    text = sub(text, r" +", " ")
    text = sub(text, r"\n\s*\n\s*\n+", "\n\n")
    return strip(translate(_no_controls(text), V.FULLWIDTH_PUNCTUATION))


def clean_basic(text: Column) -> Column:
    text = sub(text, r"\n\s*\n\s*\n", "\n\n")
    text = sub(text, r" +", " ")
    return strip(_no_controls(_plain_spaces(text)))


def clean_markdown(text: Column) -> Column:
    """Markdown syntax away, its words kept."""
    text = strip(text)
    text = sub(text, r"^---\n.*?\n---\n", "", "s")
    for pattern, replacement, flags in (
        (r"!\[([^\]]*)\]\([^)]+\)", "$1", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1", ""),
        (r"```[a-zA-Z]*\n", "", ""),
        (r"```", "", ""),
        (r"`([^`]+)`", "$1", ""),
        (r"\*\*([^*]+)\*\*", "$1", ""),
        (r"\*([^*]+)\*", "$1", ""),
        (r"__([^_]+)__", "$1", ""),
        (r"_([^_]+)_", "$1", ""),
        (r"^#{1,6}\s+", "", "m"),
        (r"^[-*+]\s+", "", "m"),
        (r"^\d+\.\s+", "", "m"),
    ):
        text = sub(text, pattern, replacement, flags)
    return clean_general(text)


def normalize_hangul_text(text: Column) -> Column:
    """Full-width punctuation to ASCII; rules of dashes and equals signs shortened."""
    text = translate(text, V.FULLWIDTH_PUNCTUATION)
    text = sub(text, r"─{2,}", "─")
    text = sub(text, r"={3,}", "===")
    return sub(text, r"-{3,}", "---")


def keep_structure(text: Column) -> Column:
    """Lines stripped; numbered Hangul headings get blank lines around them."""

    def one(line: Column) -> Column:
        heading = matches(line, r"^\d+\.?\s+[가-힣]")
        return F.when(heading, F.concat(F.lit("\n"), line, F.lit("\n"))).otherwise(line)

    return join(F.transform(F.transform(lines(text), strip), one))


def preprocess(text: Column, markdown: bool = False) -> Column:
    text = drop_junk_lines(text)
    text = clean_markdown(text) if markdown else clean_basic(text)
    return keep_structure(normalize_hangul_text(text))


def clean_patterns(text: Column, preserve_structure: bool = True) -> Column:
    """Markup, entities, page numbers, footnotes and repeated punctuation away; the original if nothing is left."""
    trailing, newlines = (r"[ \t]+$", "", "m"), (r"\n{3,}", "\n\n", "")
    spaces = [trailing, newlines] if preserve_structure else [(r"\s{2,}", " ", ""), newlines, trailing]
    rules = [
        (r"<[^>]+>", "", ""),
        (r"&[a-zA-Z0-9#]+;", "", ""),
        *spaces,
        (r"\b\d+\s*페이지\b|\bPage\s*\d+\b", "", "ib"),
        (r"\[\d+\]|\(\d+\)", "", ""),
        (r"([.,!?;:]){2,}", "$1", ""),
    ]

    def cleaned(raw: Column) -> Column:
        out = raw
        for rule in rules:
            out = sub(out, *rule)
        return let(strip(out), lambda done: F.when(done == "", strip(raw)).otherwise(done))

    return let(text, cleaned)


def normalize_punctuation(text: Column) -> Column:
    """Hangul punctuation to ASCII, a space where Hangul meets Latin, none before punctuation."""
    text = translate(text, V.HANGUL_PUNCTUATION)
    text = sub(text, r"([가-힣])([a-zA-Z])", "$1 $2")
    text = sub(text, r"([a-zA-Z])([가-힣])", "$1 $2")
    return sub(text, r"([가-힣])\s+([.,!?;:])", "$1$2")


def optimize_for_search(text: Column, join_hangul: bool = False) -> Column:
    """Search form of a text.  `join_hangul` also deletes most spaces between Hangul words, so it is off by default."""
    out = normalize_punctuation(clean_patterns(text, preserve_structure=False))
    out = sub(out, r"(\d+)\s*([가-힣]{1,2})", "$1$2")
    out = sub(out, r"(\d{4})\s*년", "$1년")
    if join_hangul:
        out = sub(out, r"([가-힣]+)\s*([가-힣]{1,2})", "$1$2")
    return strip(out)


def markdown_to_text(text: Column) -> Column:
    """Markdown to plain text; fenced code is left alone.  Images are rewritten before links."""

    def plain(part: Column) -> Column:
        for pattern, replacement, flags in (
            (r"^(#{1,6})\s*(.+?)$", "$2", "m"),
            (r"!\[([^\]]*)\]\(([^)]+)\)", "$1", ""),
            (r"\[([^\]]+)\]\(([^)]+)\)", "$1", ""),
            (r"\*\*([^*]+)\*\*", "$1", ""),
            (r"\*([^*]+)\*", "$1", ""),
            (r"`([^`]+)`", "$1", ""),
            (r"^\s*[-*+]\s+(.+)$", "$1", "m"),
            (r"^\s*\d+\.\s+(.+)$", "$1", "m"),
            (r"^>\s*(.+)$", "$1", "m"),
            (r"^[-*_]{3,}$", "", "m"),
        ):
            part = sub(part, pattern, replacement, flags)
        return part

    fence = java(r"```[\s\S]*?```")
    outside = F.split(text, fence, -1)
    blocks = F.regexp_extract_all(text, F.lit(fence), F.lit(0))
    pieces = F.transform(
        outside, lambda part, i: F.concat(plain(part), F.coalesce(F.get(blocks, i), F.lit("")))
    )
    return join(pieces, "")


# --- keyword-oriented cleaning -------------------------------------------------------------------------------------------


def clean_for_keywords(
    text: Column, remove_stopwords: bool = False, stopwords: Iterable[str] = V.CLEAN_STOPWORDS
) -> Column:
    out = sub(strip(text), r"\s+", " ")
    out = _no_zero_width(out)
    out = strip(sub(sub(out, r"[^\w\s]+", " "), r"\s+", " "))
    if remove_stopwords:
        kept = F.filter(split_words(out), lambda w: ~words_in(w, stopwords) & (F.length(w) > 1))
        out = join(kept, " ")
    return F.coalesce(out, F.lit(""))


def normalize_whitespace(text: Column) -> Column:
    return sub(strip(text), r"\s+", " ")


def remove_special_chars(text: Column, keep_punctuation: bool = False) -> Column:
    return sub(text, r"[^\w\s.,!?;:\-()]" if keep_punctuation else r"[^\w\s]", " ")


def is_valid_text(text: Column, min_length: int = 10) -> Column:
    return F.length(clean_for_keywords(text)) >= min_length


def clean_minimal(text: Column) -> Column:
    return _no_zero_width(normalize_whitespace(text))


def redact_secrets(text: Column, known_values: Iterable[str] = ()) -> Column:
    for value in known_values:
        if len(value) >= V.SECRET_MIN_LENGTH:
            text = F.replace(text, F.lit(value), F.lit(V.SECRET_MASK))
    for pattern in V.SECRET_PATTERNS:
        text = sub(text, pattern, V.SECRET_MASK)
    return text


# --- model output ------------------------------------------------------------------------------------------------------------


def strip_artifacts(text: Column) -> Column:
    for pattern in V.ARTIFACT_PATTERNS:
        text = sub(text, pattern, "", "m")
    return strip(sub(text, r"\n{3,}", "\n\n"))


def clean_context(text: Column) -> Column:
    """Instruction and role lines away.  The collapsed form is used only when no line survives."""
    collapsed = strip(sub(text, r"\s+", " "))
    for token in V.CONTEXT_TOKENS:
        collapsed = F.replace(collapsed, F.lit(token), F.lit(" "))
    rows = F.filter(F.split(text, java(r"\s*\n\s*")), lambda line: strip(line) != "")
    kept = F.filter(
        rows,
        lambda line: ~matches_any(line, V.CONTEXT_BANNED_LINES) & ~strip(line).isin(*V.CONTEXT_ROLE_LINES),
    )
    return F.when(F.size(kept) > 0, join(kept)).otherwise(collapsed)


def clean_output(text: Column) -> Column:
    for token in V.CONTEXT_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    rows = lines(sub(text, r"\n$"))
    kept = F.filter(
        rows,
        lambda line: ~contains_any(line, V.OUTPUT_BANNED_FRAGMENTS)
        & ~starts_with_any(F.lower(strip(line)), V.OUTPUT_ROLE_PREFIXES),
    )
    return join(kept)


def restore_table_rows(text: Column) -> Column:
    """Rows glued with `||` become separate table rows, outside code fences."""

    def one(line: Column) -> Column:
        start = F.instr(line, "|")
        prefix = sub(F.substring(line, F.lit(1), start - 1), r"\s+$")
        table = F.replace(F.substring(line, start, F.length(line)), F.lit("||"), F.lit("|\n|"))
        fixed = F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), table)).otherwise(table)
        return F.when(line.contains("||") & matches(line, r"\|\s*:?-{3,}:?\s*\|"), fixed).otherwise(line)

    fence = java(r"^[ \t]*(?:```|~~~).*$", "m")
    segments = F.split(text, fence, -1)
    fences = F.regexp_extract_all(text, F.lit(fence), F.lit(0))
    pieces = F.transform(
        segments,
        lambda part, i: F.concat(
            F.when(i % 2 == 0, join(F.transform(lines(part), one))).otherwise(part),
            F.coalesce(F.get(fences, i), F.lit("")),
        ),
    )
    return F.when(text.contains("||"), join(pieces, "")).otherwise(text)


def repair_answer_markdown(text: Column) -> Column:
    headings = sorted({a for aliases in V.SECTION_ALIASES.values() for a in aliases}, key=len, reverse=True)
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = sub(out, r"(?<=[^\s#])[ \t]*(#{1,6})[ \t]+(?=\S)", "\n\n$1 ")
    out = sub(out, r"^(#{1,6}[ \t]*)(" + "|".join(headings) + r"):?[ \t]*(?=\S)", "$1$2\n", "m")
    out = sub(out, r"(?<=\S)[ \t]{2,}[-*][ \t]+", "\n- ")
    out = restore_table_rows(out)
    return strip(sub(out, r"\n{3,}", "\n\n"))


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def inline_markup(text: Column) -> Column:
    """HTML-safe text with bold spans and one badge per cited source number."""
    out = sub(escape_markup(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    cite = java(r"\[출처\s*([0-9,\s]+)\]")
    outside = F.split(out, cite, -1)
    groups = F.regexp_extract_all(out, F.lit(cite), F.lit(1))

    def badges(group: Column) -> Column:
        numbers = F.regexp_extract_all(group, F.lit(java(r"\d+")), F.lit(0))
        return join(F.transform(numbers, lambda n: F.concat(F.lit('<span class="cite">출처 '), n, F.lit("</span>"))), " ")

    return join(
        F.transform(outside, lambda part, i: F.concat(part, F.coalesce(badges(F.get(groups, i)), F.lit("")))), ""
    )


def normalize_lists(text: Column) -> Column:
    """`1.`, `1)` and bullet signs become `- `."""

    def one(line: Column) -> Column:
        indent = F.regexp_extract(line, java(r"^(\s*)"), 1)
        bare = F.substring(line, F.length(indent) + 1, F.length(line))
        numbered = matches(bare, r"^\d+[.)]\s+")
        item = strip(sub(bare, r"^\d+[.)]\s+"))
        bullet = strip(sub(bare, r"^•+"))
        return (
            F.when(numbered, F.concat(indent, F.lit("- "), item))
            .when(bare.startswith("•"), F.concat(indent, F.lit("- "), bullet))
            .otherwise(line)
        )

    return F.when(strip(text) == "", strip(text)).otherwise(strip(join(F.transform(lines(sub(text, r"\n$")), one))))


def strip_noise_lines(text: Column) -> Column:
    text = sub(text, r"\n\s*\n\s*\n", "\n\n")
    text = sub(text, r"^[Pp]age\s*\d+.*$", "", "m")
    text = sub(text, r"^\s*\d+\s*$", "", "m")
    return sub(text, r"^\s*-\s*\d+\s*-\s*$", "", "m")


def fix_headings(text: Column) -> Column:
    """`### 다.` is a cut sentence end, not a heading."""
    text = sub(text, r"^###\s*다\.\s*$", "다.", "m")
    return sub(text, r"^###\s(\s*[가-힣]\.\s*)$", "$1", "m")


def collapse_blank_lines(text: Column) -> Column:
    return sub(text, r"\n{3,}", "\n\n")


def drop_page_markers(text: Column) -> Column:
    return strip(sub(text, V.PAGE_MARKER, "", "m"))


def is_error_message(text: Column, keywords: Iterable[str] = V.ERROR_KEYWORDS) -> Column:
    return (F.length(text) <= 280) & contains_any(F.lower(text), keywords)


def display_name(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(F.replace(name, F.lit("+"), F.lit(" ")))


# --- counts and scores over one text -----------------------------------------------------------------------------------------


def text_statistics(text: Column) -> dict[str, Column]:
    chars = F.length(text)
    hangul = count_matches(text, r"[가-힣]")
    latin = count_matches(text, r"[a-zA-Z]")
    digits = count_matches(text, r"\d")
    return {
        "total_chars": chars,
        "total_chars_no_spaces": F.length(F.replace(text, F.lit(" "), F.lit(""))),
        "total_words": F.size(split_words(text)),
        "total_lines": F.size(lines(text)),
        "total_sentences": count_matches(text, r"[.!?]+"),
        "hangul_chars": hangul,
        "latin_chars": latin,
        "digits": digits,
        "punctuation": count_matches(text, r"[.,!?;:]"),
        "hangul_ratio": hangul / chars,
        "latin_ratio": latin / chars,
        "digit_ratio": digits / chars,
    }


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two arrays taken as sets: 1 for two empty ones, 0 when only one is empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def word_set(text: Column) -> Column:
    return F.array_distinct(split_words(text))


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def run_lengths(items: Column) -> Column:
    """Histogram of an array without leaving the row: [(item, count)], by sorting and measuring runs."""

    def measured(ordered: Column) -> Column:
        first = F.transform(
            ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), F.struct(x.alias("x"), i.alias("at")))
        )
        return let(
            F.filter(first, lambda s: s.isNotNull()),
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(
                    s["x"].alias("item"),
                    (F.coalesce(F.get(starts, j + 1)["at"], F.size(ordered)) - s["at"]).cast("bigint").alias("n"),
                ),
            ),
        )

    return let(F.sort_array(items), measured)


def first_seen_counts(items: Column) -> Column:
    """Like run_lengths, with the position where each item first occurs: [(item, n, first)]."""
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def measured(ordered: Column) -> Column:
        opened = F.transform(
            ordered,
            lambda s, i: F.when(
                (i == 0) | (s["x"] != F.get(ordered, i - 1)["x"]), F.struct(s["x"].alias("x"), s["i"].alias("i"), i.alias("at"))
            ),
        )
        return let(
            F.filter(opened, lambda s: s.isNotNull()),
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(
                    s["x"].alias("item"),
                    (F.coalesce(F.get(starts, j + 1)["at"], F.size(ordered)) - s["at"]).cast("bigint").alias("n"),
                    s["i"].alias("first"),
                ),
            ),
        )

    return let(F.sort_array(placed), measured)
