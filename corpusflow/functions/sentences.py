"""Predicates and splitters for lines and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.functions.patterns import java, literal_class

# everything that marks a stripped line as cut off, as one alternation
INCOMPLETE = "|".join(
    (
        *V.VERB_STEMS,
        *V.PROPER_NOUN_CUTS,
        *V.SINGLE_CHAR_CUTS,
        literal_class(dict.fromkeys(V.PROBLEM_ENDINGS + V.PARTICLES + V.CONNECTIVE_ENDINGS + V.LOOSE_JAMO)) + "$",
        r"[0-9A-Za-z]$",
        r"(?:^|\s)[가-힣]{1,2}$",
        *(r"(?:^|\s)[가-힣]{2}" + pattern.removeprefix(".*") for pattern in V.THREE_CHAR_NOUNS),  # the last word of three
    )
)
SIMPLE = "|".join((*V.SIMPLE_INCOMPLETE, literal_class(V.SIMPLE_PARTICLES) + "$"))
NO_JOIN = "|".join(V.NO_JOIN_BEFORE)


def is_incomplete(line: Column) -> Column:
    """Whether a line breaks off before its sentence ends."""

    def judged(bare: Column) -> Column:
        hangul_end = T.ends_with_any(bare, V.KOREAN_ENDINGS)
        return (
            F.when((bare == "") | T.ends_with_any(bare, V.COMPLETE_ENDINGS), False)
            .when(hangul_end & (F.length(bare) == 1), True)
            .when(hangul_end & (F.length(bare) > 10), False)
            .otherwise(T.matches(bare, INCOMPLETE))
        )

    return T.let(T.strip(line), judged)


def can_join(line: Column, following: Column) -> Column:
    """Whether the next line may continue this one: neither is structure and the next starts nothing new."""
    current, after = T.strip(line), T.strip(following)
    return (
        (current != "")
        & (after != "")
        & ~T.matches(current, V.STRUCTURE_LINE)
        & ~T.matches(after, V.STRUCTURE_LINE)
        & ~T.starts_with_any(after, V.SENTENCE_STARTERS)
        & ~T.matches(after, NO_JOIN)
    )


def ends_mid_sentence(line: Column) -> Column:
    """Incomplete, or a prose line of some length without an end mark; a trailing page number ends it."""

    def judged(bare: Column) -> Column:
        prose = (
            (F.length(bare) >= V.MIN_PROSE_LINE)
            & ~T.matches(bare, V.STRUCTURE_LINE)
            & ~T.matches(bare, r"[.!?\d]$")
        )
        return ~T.matches(bare, r"\s\d{1,4}$") & (is_incomplete(bare) | prose)

    return T.let(T.strip(line), judged)


_FIRST_SENTENCE = r"^(.*?[.!?])(\s.*)?$"


def sentence_head(line: Column) -> Column:
    """The line up to its first sentence end; the whole line if it has none."""
    head = F.regexp_extract(line, java(_FIRST_SENTENCE), 1)
    return T.strip(F.when(T.matches(line, _FIRST_SENTENCE), head).otherwise(line))


def sentence_rest(line: Column) -> Column:
    return T.strip(F.regexp_extract(line, java(_FIRST_SENTENCE), 2))


def is_incomplete_simple(line: Column) -> Column:
    bare = T.strip(line)
    return (bare != "") & ~T.ends_with_any(bare, V.COMPLETE_ENDINGS) & T.matches(bare, SIMPLE)


def ends_complete(line: Column) -> Column:
    return (line == "") | T.ends_with_any(line, V.SENTENCE_CLOSERS)


def split_sentences(text: Column) -> Column:
    """Sentences with their end marks; the rest after the last mark counts as one."""
    parts = F.regexp_extract_all(text, F.lit(java(r"[^.!?]*[.!?]|[^.!?]+$")), F.lit(0))
    return F.filter(F.transform(parts, T.strip), lambda s: s != "")


def split_at_spaces(text: Column) -> Column:
    """Sentences cut at the whitespace after an end mark."""
    return F.split(T.strip(text), java(r"(?<=[.!?])\s+"))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Stripped non-empty pieces between separators; `\\n\\s*\\n` splits on blank lines."""
    return F.filter(F.transform(F.split(text, java(separator)), T.strip), lambda p: p != "")


# --- headings ---------------------------------------------------------------------------------------------------------------


def is_heading(line: Column, following: Column) -> Column:
    """A heading: short, no sentence ending, and a heading pattern, capitals, or a keyword before a long line."""
    capitals = (F.upper(line) == line) & (F.length(line) < 50) & T.matches(line, r"[A-Z]")
    keyword = (
        T.starts_with_any(line, V.HEADING_KEYWORDS)
        & (F.length(line) < 80)
        & (F.length(T.strip(F.coalesce(following, F.lit("")))) > 20)
    )
    return (
        (F.length(line) <= 100)
        & ~T.ends_with_any(line, V.HEADING_STOP_ENDINGS)
        & (T.matches_any(line, V.HEADING_PATTERNS) | capitals | keyword)
    )


def heading_level(line: Column, by_specificity: bool = False) -> Column:
    """Level of a heading by its first matching pattern; `by_specificity` tries 1.1.1 and 1.1 before 1."""
    rules = sorted(V.HEADING_LEVELS, key=lambda r: -r[0].count(r"\d+")) if by_specificity else V.HEADING_LEVELS
    level = F
    for pattern, number in rules:
        level = level.when(T.matches(line, pattern), number)
    return level.otherwise(V.DEFAULT_HEADING_LEVEL)


def paragraph_title_level(paragraph: Column) -> Column:
    """Heading level a paragraph's first line asks for, 0 for body text."""
    first = F.substring_index(T.strip(paragraph), "\n", 1)
    return (
        F.when(~T.matches_any(first, V.TITLE_PATTERNS), 0)
        .when(T.matches(first, r"^\d+\."), 1)
        .when(T.matches(first, r"^[가-힣]\."), 2)
        .otherwise(3)
    )
