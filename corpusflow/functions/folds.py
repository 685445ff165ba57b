"""Left-to-right folds inside one row.

Only lengths and flags cross to Python (Arrow batches of small integer arrays); the text stays in the JVM and is
re-assembled there from the returned positions.  Every fold is linear in the number of items and never shuffles.
Each returns groups as arrays of item positions, so `assemble` can join them.  A task has one Python worker for each fold
of its plan, so the folds work on Arrow arrays and hold the items of one row at a time as Python objects.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

# types as objects: workers import this module without a session to parse type strings
GROUPS = ArrayType(ArrayType(IntegerType()))


def row_udf(returns):
    """An Arrow UDF that the optimizer evaluates once per row: it may neither copy it into filters nor inline it."""

    def wrap(fn):
        return arrow_udf(fn, returns).asNondeterministic()

    return wrap


def assemble(items: Column, groups: Column, separator: str) -> Column:
    """array<array<position>> -> array<joined text>."""
    return F.transform(groups, lambda g: F.array_join(F.transform(g, lambda i: F.get(items, i)), separator))


def _rows(columns: tuple[pa.ListArray, ...]) -> Iterator[tuple[list, ...] | None]:
    """The arrays of every row as lists; None for a row whose first array is null."""
    ends = [c.offsets.to_numpy() for c in columns]
    values = [c.values.to_numpy(zero_copy_only=False) for c in columns]
    for i, held in enumerate(columns[0].is_valid().to_numpy(zero_copy_only=False)):
        yield tuple(v[e[i] : e[i + 1]].tolist() for v, e in zip(values, ends)) if held else None


def _lists(ends: array, values: pa.Array, like: pa.Array | None = None) -> pa.ListArray:
    """Values as lists that end at `ends`; null where `like` is null."""
    offsets = pa.array(np.frombuffer(ends, np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=like.is_null() if like is not None and len(like) else None)


def _grouping(fold: Callable[..., list[list[int]]]):
    """A fold over the arrays of one row as a function of Arrow arrays."""

    def apply(*columns: pa.ListArray) -> pa.ListArray:
        items, groups, rows = array("i"), array("i", [0]), array("i", [0])
        for row in _rows(columns):
            for group in fold(*row) if row is not None else ():
                items.extend(group)
                groups.append(len(items))
            rows.append(len(groups) - 1)
        return _lists(rows, _lists(groups, pa.array(np.frombuffer(items, np.int32))), columns[0])

    return apply


@row_udf(ArrayType(IntegerType()))
def running_total(values: pa.Array) -> pa.Array:
    """Sum of everything up to and including each item."""
    totals, rows = array("i"), array("i", [0])
    for row in _rows((values,)):
        totals.extend(np.cumsum(row[0] if row is not None else [], dtype="int64").tolist())
        rows.append(len(totals))
    return _lists(rows, pa.array(np.frombuffer(totals, np.int32)), values)


def pair_up(edges: Column) -> Column:
    """Greedy pairs: item i takes i + 1 when edges[i] holds and i is not already taken."""

    def fold(flags) -> list[list[int]]:
        groups, i = [], 0
        while i < len(flags):
            step = 2 if flags[i] and i + 1 < len(flags) else 1
            groups.append(list(range(i, i + step)))
            i += step
        return groups

    @row_udf(GROUPS)
    def pairs(flags: pa.Array) -> pa.Array:
        return _grouping(fold)(flags)

    return pairs(edges)


def _packing(limit: int, separator: int, minimum: int, tested_gap: int) -> Callable[..., list[list[int]]]:
    def fold(sizes, flags=None) -> list[list[int]]:
        groups: list[list[int]] = []
        used = 0
        for i, size in enumerate(sizes):
            full = used + tested_gap + size > limit and used >= minimum
            if not groups or full or (flags is not None and flags[i]):
                groups.append([i])
                used = int(size)
            else:
                groups[-1].append(i)
                used += separator + int(size)
        return groups

    return fold


def pack(
    lengths: Column, limit: int, separator: int = 2, minimum: int = 0, counted: int | None = None,
    breaks: Column | None = None,
) -> Column:
    """Greedy bins: an item opens a new bin when it would push a bin of at least `minimum` characters past `limit`.

    `separator` characters join the items of a bin; `counted` of them enter the overflow test (default: the joined size).
    An item with a true `breaks` flag opens a new bin in any case.
    """
    fold = _packing(limit, separator, minimum, separator if counted is None else counted)

    @row_udf(GROUPS)
    def bins(sizes: pa.Array) -> pa.Array:
        return _grouping(fold)(sizes)

    @row_udf(GROUPS)
    def broken_bins(sizes: pa.Array, flags: pa.Array) -> pa.Array:
        return _grouping(fold)(sizes, flags)

    return bins(lengths) if breaks is None else broken_bins(lengths, breaks)


def _merge_small(sizes, flags, minimum: int) -> list[list[int]]:
    groups: list[list[int]] = []
    for i, size in enumerate(sizes):
        if groups and size < minimum and not flags[i]:
            groups[-1].append(i)
        else:
            groups.append([i])
    return groups


def merge_small(lengths: Column, fixed: Column, minimum: int) -> Column:
    """An item below `minimum` that is not fixed joins the group before it."""

    def fold(sizes, flags) -> list[list[int]]:
        return _merge_small(sizes, flags, minimum)

    @row_udf(GROUPS)
    def merged(sizes: pa.Array, flags: pa.Array) -> pa.Array:
        return _grouping(fold)(sizes, flags)

    return merged(lengths, fixed)


def pack_and_merge(lengths: Column, breaks: Column, fixed: Column, limit: int, separator: int, counted: int, minimum: int) -> Column:
    """array<array<array<position>>>: the bins of `pack`, and of these the groups of `merge_small`, in one worker.

    A bin is as long as its items and separators and fixed as its first item.
    """
    fold = _packing(limit, separator, 0, counted)

    @row_udf(ArrayType(GROUPS))
    def merged(sizes: pa.Array, flags: pa.Array, kept: pa.Array) -> pa.Array:
        items, bins, groups, rows = array("i"), array("i", [0]), array("i", [0]), array("i", [0])
        for row in _rows((sizes, flags, kept)):
            packed = fold(*row[:2]) if row is not None else []
            for b in packed:
                items.extend(b)
                bins.append(len(items))
            totals = [sum(row[0][i] for i in b) + separator * (len(b) - 1) for b in packed]
            for group in _merge_small(totals, [row[2][b[0]] for b in packed], minimum):
                groups.append(groups[-1] + len(group))
            rows.append(len(groups) - 1)
        return _lists(rows, _lists(groups, _lists(bins, pa.array(np.frombuffer(items, np.int32)))), sizes)

    return merged(lengths, breaks, fixed)


def merge_short(lengths: Column, own: Column, short: int, limit: float, keep: int) -> Column:
    """Chunks shorter than `short` join the previous one while the result fits; else they stay if `keep` long.

    `lengths` are stripped sizes, `own` the unstripped size a kept chunk contributes.
    """

    def fold(stripped, raw) -> list[list[int]]:
        groups: list[list[int]] = []
        used = 0
        for i, size in enumerate(stripped):
            if size < short and groups and used + 2 + size <= limit:
                groups[-1].append(i)
                used += 2 + int(size)
            elif size >= keep:
                groups.append([i])
                used = int(raw[i])
        return groups

    @row_udf(GROUPS)
    def merged(stripped: pa.Array, raw: pa.Array) -> pa.Array:
        return _grouping(fold)(stripped, raw)

    return merged(lengths, own)


def cut_at_boundaries(lengths: Column, safe: Column, target: int, maximum: int) -> Column:
    """A group closes at `target` characters after a safe item, and at `maximum` in any case."""

    def fold(sizes, flags) -> list[list[int]]:
        groups: list[list[int]] = []
        used, fresh = 0, True
        for i, size in enumerate(sizes):
            if fresh:
                groups.append([])
                used = 0
            groups[-1].append(i)
            used += int(size) + 2
            fresh = used >= maximum or (used >= target and bool(flags[i]))
        return groups

    @row_udf(GROUPS)
    def cuts(sizes: pa.Array, flags: pa.Array) -> pa.Array:
        return _grouping(fold)(sizes, flags)

    return cuts(lengths, safe)


def bounded_bins(lengths: Column, limit: int) -> Column:
    """Greedy bins of at most `limit`; a larger item is alone in its bin."""

    def fold(sizes) -> list[list[int]]:
        groups: list[list[int]] = []
        used, closed = 0, True
        for i, size in enumerate(sizes):
            if size > limit:
                groups.append([i])
                closed = True
            elif not closed and used + size <= limit:
                groups[-1].append(i)
                used += int(size)
            else:
                groups.append([i])
                used, closed = int(size), False
        return groups

    @row_udf(GROUPS)
    def bins(sizes: pa.Array) -> pa.Array:
        return _grouping(fold)(sizes)

    return bins(lengths)


def _adjusted(flags, values, high: float, low: float) -> list[bool]:
    flags = [bool(f) for f in flags]
    for i in range(len(flags) - 1):
        value = values[i]
        if flags[i] or value is None or np.isnan(value):
            continue
        if value > high:
            flags[i + 1] = False
        elif value < low:
            flags[i + 1] = True
    return flags


def adjust_boundaries(boundary: Column, similarity: Column, high: float, low: float) -> Column:
    """Boundaries between neighbours revised left to right; an item that is a boundary itself is not looked at.

    boundary[i] marks item i as a segment start, similarity[i] compares items i and i + 1 (null when either is empty).
    """

    @row_udf(ArrayType(BooleanType()))
    def revised(starts: pa.Array, near: pa.Array) -> pa.Array:
        flags, rows = array("b"), array("i", [0])
        for row in _rows((starts, near)):
            flags.extend(_adjusted(*row, high, low) if row is not None else ())
            rows.append(len(flags))
        return _lists(rows, pa.array(np.frombuffer(flags, np.int8) != 0), starts)

    return revised(boundary, similarity)


def _segments(flags) -> list[list[int]]:
    groups: list[list[int]] = []
    for i, flag in enumerate(flags):
        if flag or not groups:
            groups.append([])
        groups[-1].append(i)
    return groups


def segments(starts: Column) -> Column:
    """Groups of positions between segment starts."""

    @row_udf(GROUPS)
    def cut(flags: pa.Array) -> pa.Array:
        return _grouping(_segments)(flags)

    return cut(starts)


def adjusted_segments(boundary: Column, similarity: Column, high: float, low: float) -> Column:
    """The segments between the boundaries that adjust_boundaries gives, in one worker."""

    def fold(flags, values) -> list[list[int]]:
        return _segments(_adjusted(flags, values, high, low))

    @row_udf(GROUPS)
    def cut(starts: pa.Array, near: pa.Array) -> pa.Array:
        return _grouping(fold)(starts, near)

    return cut(boundary, similarity)
