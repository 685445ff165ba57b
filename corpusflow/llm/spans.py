"""Spans of patterns in whole texts as column expressions, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,match:string,before:string>>"
STEP = 128  # matches that one fold takes: its cost grows with the square of them
BEFORE = 48  # code points of context that a match keeps


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern as [(start, end, match, before)], `end` exclusive, in code points.

    The text is cut at the matches; gaps and matches in turn give all positions by adding up lengths, in blocks of STEP
    matches, so the cost is linear in the text. `before` is what stands before the match, back to the match before it and
    at most BEFORE code points. `hint` is a cheap condition that every text with a match meets.
    """
    none = F.array().cast(SPAN)

    def place(found: Column) -> Column:
        return F.when(F.size(found) == 0, none).otherwise(let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match")), blocks))

    def blocks(pairs: Column) -> Column:
        count = F.size(pairs) - 1  # the last gap has no match
        cut = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / STEP).cast("int")), lambda b: F.slice(pairs, b * STEP + 1, F.least(F.lit(STEP), count - b * STEP)))
        return let(cut, lambda parts: F.flatten(F.zip_with(parts, _starts(parts), _fold)))

    spans = let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), place)
    return spans if hint is None else F.when(hint, spans).otherwise(none)


def _length(pair: Column) -> Column:
    return F.char_length(pair["gap"]) + F.char_length(pair["match"])


def _starts(parts: Column) -> Column:
    """Code points before each block."""
    totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, p: s + _length(p)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(totals, empty, lambda s, t: F.struct((s["at"] + t).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])


def _fold(part: Column, start: Column) -> Column:
    def step(state: Column, pair: Column) -> Column:
        low = state["at"] + F.char_length(pair["gap"])
        high = state["at"] + _length(pair)
        span = F.struct(low.alias("start"), high.alias("end"), pair["match"].alias("match"), F.substring(pair["gap"], -BEFORE, BEFORE).alias("before"))
        return F.struct(high.alias("at"), F.concat(state["spans"], F.array(span)).cast(SPAN).alias("spans"))

    return F.aggregate(part, F.struct(start.alias("at"), F.array().cast(SPAN).alias("spans")), step, lambda s: s["spans"])


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when the digits pass the Luhn check."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans (kind, start, end) by start, then kind as listed, then end, joined by commas."""
    order = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.array_join(F.transform(F.sort_array(order), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
