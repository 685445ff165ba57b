"""Quality scores of texts.  Each document is scored inside its row; model-given scores are input columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import fixed_values as V
from corpusflow.functions import sentences as L
from corpusflow.functions import text as T


def _headings(text: Column, pattern: str) -> Column:
    """Number of `#` of every heading line, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(T.java(pattern, "m")), F.lit(1)), F.length)


def sentence_completion(text: Column) -> Column:
    """Share of body lines that end a sentence, in percent; 100 without body lines."""
    rows = F.filter(
        F.transform(T.lines(text), T.strip),
        lambda line: (line != "") & ~line.startswith("#") & ~T.matches(line, r"^\d+\)") & ~line.contains("........"),
    )
    return T.let(
        rows,
        lambda r: F.when(F.size(r) == 0, 100.0).otherwise(
            (F.size(r) - F.size(F.filter(r, L.is_incomplete_simple))) / F.size(r) * 100
        ),
    )


def structure_preservation(text: Column) -> Column:
    """100, less 5 per heading jump of more than two levels, plus 5 for any structure, within 70 and 100."""
    listed = T.matches(text, r"^\s*[-*+]\s+.+$", "m") | T.matches(text, r"^\s*\d+\.\s+.+$", "m")

    def score(levels: Column) -> Column:
        jumps = F.size(F.filter(F.transform(levels, lambda x, i: x - F.get(levels, i - 1)), lambda d: d > 2))
        raw = 100.0 - 5 * jumps
        return F.greatest(F.lit(70.0), F.when((F.size(levels) > 0) | listed, F.least(F.lit(100.0), raw + 5)).otherwise(raw))

    return T.let(_headings(text, r"^(#+)\s+.+$"), score)


def total_quality(
    sentence: Column, spacing: Column, context: Column, structure: Column, target: float = 90.0
) -> dict[str, Column]:
    """Weighted total, pass flag and the clamped target."""
    goal = max(70.0, min(100.0, target))
    total = sum((s * w for s, w in zip((sentence, spacing, context, structure), V.QUALITY_WEIGHTS)), F.lit(0.0))
    return {"total_score": F.round(total, 1), "passed": total >= goal, "target_score": F.lit(goal)}


def improvements(sentence: Column, spacing: Column, context: Column, structure: Column) -> Column:
    scores = {"sentence": sentence, "spacing": spacing, "context": context, "structure": structure}
    notes = F.array_compact(F.array(*(F.when(scores[n] < limit, note) for n, limit, note in V.IMPROVEMENTS)))
    return F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(V.NO_IMPROVEMENT)))


def context_quality(text: Column, sample_score: Column | None = None) -> Column:
    """Cut-off patterns against a tenth of the lines, averaged with a sample score."""
    broken = sum((T.count_matches(text, p) for p in V.BROKEN_CONTEXT), F.lit(0))
    share = F.greatest(F.lit(0.0), 1.0 - broken / F.greatest(F.size(T.lines(text)) * 0.1, F.lit(1.0)))
    return (share + (F.lit(0.7) if sample_score is None else sample_score)) / 2


def heading_quality(text: Column) -> Column:
    """1, less 0.2 per jump of more than one level, 0.1 per cut sentence end posing as heading, 0.05 per empty heading."""

    def hierarchy(levels: Column) -> Column:
        jumps = F.size(
            F.filter(F.transform(levels, lambda x, i: x - F.coalesce(F.get(levels, i - 1), F.lit(0))), lambda d: d > 1)
        )
        return F.when(F.size(levels) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - jumps * 0.2))

    wrong = T.count_matches(text, r"^###\s*[가-힣]{1,2}\.\s*$", "m")
    empty = T.count_matches(text, r"^#{1,6}\s*$", "m")
    return F.greatest(F.lit(0.0), T.let(_headings(text, r"^(#{1,6})\s+.+$"), hierarchy) - wrong * 0.1 - empty * 0.05)


ODD_CHARACTERS = r"[^\w\s.,!?()\[\]{}`#*-]"


def readability(text: Column) -> Column:
    """1, less 0.1 each for blank-line runs, many long sentences and many odd characters."""
    gaps = T.count_matches(text, r"\n{4,}") > 0
    long = T.let(
        F.split(text, T.java(r"[.!?]\s+")),
        lambda s: F.size(F.filter(s, lambda x: F.length(x) > 200)) > F.size(s) * 0.2,
    )
    odd = T.count_matches(text, ODD_CHARACTERS) > 20
    return F.greatest(F.lit(0.0), 1.0 - (gaps.cast("int") + long.cast("int") + odd.cast("int")) * 0.1)


def report(text: Column, sample_score: Column | None = None) -> dict[str, Column]:
    """The three metrics, their mean, and what to improve below 0.8."""
    metrics = {
        "context_score": context_quality(text, sample_score),
        "structure_score": heading_quality(text),
        "readability_score": readability(text),
    }
    overall = sum(metrics.values(), F.lit(0.0)) / 3
    notes = F.array_compact(F.array(*(F.when(metrics[n] < 0.7, note) for n, note in V.REPORT_IMPROVEMENTS)))
    empty = F.array().cast("array<string>")
    return {**metrics, "overall_score": overall, "improvements": F.when(overall < 0.8, notes).otherwise(empty)}


def body_sample(text: Column, chars: int = 500) -> Column:
    """Start of the text without headings and blank lines: the input of a sampling model score."""
    rows = F.filter(T.lines(text), lambda line: (T.strip(line) != "") & ~T.strip(line).startswith("#"))
    return F.left(T.join(rows), F.lit(chars))


def spaced_sample(text: Column, count: int = 20) -> Column:
    """Up to twenty evenly spaced body lines of more than ten characters."""

    def pick(rows: Column) -> Column:
        interval = F.greatest(F.lit(1), F.floor(F.size(rows) / count).cast("int"))
        chosen = F.transform(F.filter(rows, lambda line, i: i % interval == 0), T.strip)
        return F.slice(
            F.filter(chosen, lambda line: (F.length(line) > 10) & ~line.startswith("#")), 1, count
        )

    return T.let(T.lines(text), pick)
