"""Sets of word shingles as 64-bit hashes, computed for a whole Arrow batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BYTES_AT_ONCE = 1 << 20  # of text; bounds the working memory (a longer text is taken alone)

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BYTE_CODES[65:91] = BYTE_CODES[97:123]  # A-Z count as a-z
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACES = [np.uint64(v) for v in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, STEP, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) of texts that lie side by side, and the first word of each text."""
    solid = ~SPACES[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = solid[edges]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), first
    codes, where = BYTE_CODES[data[solid]], np.flatnonzero(starts[solid])
    lengths = np.diff(np.append(where, len(codes)))
    place = np.arange(len(codes)) - np.repeat(where, lengths)
    return mixed(np.add.reduceat(codes * _powers(int(lengths.max()))[place], where)), first


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """The set of each text as sorted hashes: its runs of `size` words, the whole text if it has fewer, nothing if it has none."""
    n = len(words) - size + 1
    runs = mixed(sum((words[j : n + j] * PLACES[j % 5] for j in range(size)), np.uint64(0))) if n > 0 else np.zeros(0, np.uint64)
    for low, high in zip(first[:-1], first[1:]):
        if high - low >= size:
            yield np.unique(runs[low : high - size + 1])
        elif high > low:
            short = sum((words[low + j] * PLACES[j % 5] for j in range(high - low)), np.uint64(high - low))
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def text_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The shingle set of every text of an Arrow array of strings without nulls."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BYTES_AT_ONCE, side="right")) - 1)
        part = data[offsets[low] : offsets[high]]
        with np.errstate(over="ignore"):
            yield from shingle_sets(*word_hashes(part, offsets[low : high + 1] - offsets[low]), size)
        low = high


def set_key(values: np.ndarray) -> int:
    """A 64-bit hash of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([values.sum(dtype=np.uint64) ^ np.uint64(len(values))], np.uint64)).view(np.int64)[0])


def set_check(values: np.ndarray) -> int:
    """Another 64-bit hash, to tell sets of equal keys apart."""
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce((values + STEP) * (values | np.uint64(1))).view(np.int64)) if len(values) else 0
