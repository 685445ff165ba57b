"""Words and tokens of whole Arrow batches: what T.split_words and T.tokens give, without a JVM expression for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusflow.functions.patterns import WORD


def lists_of(values: pa.Array, row: np.ndarray, rows: int) -> pa.ListArray:
    """Values in order of their row as one list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32()), values)


def rows_of(lists: pa.ListArray) -> np.ndarray:
    """The row of every item of an array of lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def _pieces(lists: pa.ListArray, minimum: int, without: pa.Array | None = None) -> pa.ListArray:
    flat = lists.flatten()
    held = pc.greater_equal(pc.utf8_length(flat), minimum)
    if without is not None:
        held = pc.and_(held, pc.invert(pc.is_in(flat, without)))
    return lists_of(flat.filter(held), rows_of(lists)[held.to_numpy(zero_copy_only=False)], len(lists))


def words(texts: pa.Array) -> pa.ListArray:
    """Words between runs of whitespace; none for null."""
    return _pieces(pc.utf8_split_whitespace(texts), 1)  # splits at the members of patterns.WHITESPACE


def tokens(lowered: pa.Array, stopwords=()) -> pa.ListArray:
    """Tokens of two or more word characters of texts that are lower case already; none for null."""
    return _pieces(pc.split_pattern_regex(lowered, f"[^{WORD}]+"), 2, pa.array(stopwords, pa.string()) if stopwords else None)
