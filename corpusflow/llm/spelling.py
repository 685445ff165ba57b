"""Spelling variants: words one edit apart, found from the Gram matrices of blocks of letter counts.

One inserted or deleted letter changes one letter count by one, one replaced letter changes two, so near words lie within a
squared distance of two, and at least one of any three groups of letters has equal counts in both. Words are put together
by the counts of each third of the letters; a block that is still large is split again by thirds of its other letters.
Inside a block the words lie by length, and one matrix product gives the distances between those of a length and of the
next. Pairs within two are verified letter by letter. A pair may meet in several blocks and counts in the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import LOWER, UPPER, scratch, text_of
from corpusflow.operators.lexical import explode_once
from corpusflow.session import cut_lineage

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
SLIP = 31  # one of so many runs loses a letter
BLOCK, STRIP, DEPTH = 4096, 256, 3
COLUMNS = 48  # of letter counts; the rarest letters share the last, which only adds pairs to verify

_rng = np.random.default_rng(20240917)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)  # near words differ in a sum of codes wherever they differ in counts
PATH_CODES = _rng.integers(1, 2**63, 3**DEPTH * 2, dtype=np.uint64)


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, one in `slip` by CRC-32 of key and run without a letter."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found = F.regexp_extract_all(text_of(text), F.lit(f"[{LETTERS}]{{{letters},}}"), F.lit(0))
    runs = explode_once(docs.select(name.alias("key"), found.alias("runs")), "runs", "run")
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    hashed = runs.select("key", run.alias("run")).select("run", F.crc32(F.concat("key", F.lit(":"), "run")).alias("hash"))
    at = (F.col("hash") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("hash") % slip == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


# --- letters and blocks --------------------------------------------------------------------------------------------------------


def _coded(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words side by side as Latin-1, and the words' lengths."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8), lengths


def letter_order(words: DataFrame) -> np.ndarray:
    """The Latin-1 codes, the most frequent letter of the words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.bincount(_coded(batch.column(0))[0], minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0].astype(np.int64))], names=["code", "n"])

    counts = np.zeros(256, np.int64)
    for row in words.select("word").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():  # 90 letters
        counts[row["code"]] = row["n"]
    return np.argsort(-counts, kind="stable")


def _thirds(order: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Three sets of the letters in `rest` with nearly equal numbers of occurrences: dealt to and fro by frequency."""
    out = [np.zeros(256, bool) for _ in range(3)]
    for i, code in enumerate(c for c in order if rest[c]):
        out[i % 3 if i // 3 % 2 == 0 else 2 - i % 3][code] = True
    return out


class Paths:
    """The sets of letters at every path: 0 is the root, 3 p + 1 + g its path p with the third g of the letters left there."""

    def __init__(self, order: np.ndarray):
        self.chosen, self.parts = {0: np.zeros(256, bool)}, {}
        for path in range((3**DEPTH - 1) // 2):
            self.parts[path] = _thirds(order, ~self.chosen[path])
            for g, letters in enumerate(self.parts[path]):
                self.chosen[3 * path + 1 + g] = self.chosen[path] | letters
        rank = np.empty(256, np.int64)
        rank[order] = np.arange(256)
        self.column = np.minimum(rank, COLUMNS - 1)

    def earlier(self, path: int) -> list[np.ndarray]:
        """The sets that a pair which counts at the path must not have in common."""
        out = []
        while path:
            path, g = (path - 1) // 3, (path - 1) % 3
            out += self.parts[path][:g]
        return out


def _sums(codes: np.ndarray, starts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For every word a number that its counts of the given letters decide."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(np.where(letters, CODES, np.uint64(0))[codes], starts)


def _split(paths: Paths) -> Callable:
    """Rows (path, word, n) to three rows (key, path, word, n) each, one for every third of the letters left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes, lengths = _coded(batch.column(1))
            starts, at = np.cumsum(lengths) - lengths, batch.column(0).to_numpy()
            for g in range(3):
                key = np.zeros(len(batch), np.uint64)
                for path in np.unique(at):
                    child = 3 * int(path) + 1 + g
                    key = np.where(at == path, _sums(codes, starts, paths.chosen[child]) ^ PATH_CODES[child], key)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((3 * at + 1 + g).astype(np.int32)), batch.column(1), batch.column(2)], names=["key", "path", "word", "n"])

    return run


def blocks(words: DataFrame, paths: Paths, keep: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """(key, low, high, own, path, word, n): every word in its blocks; near words meet in at least one of them.

    Blocks of more than `block` words are split by further letters; what DEPTH thirds leave larger is dealt out in slices,
    and every two slices, `low` and `high`, meet; `own` is a row's slice.
    """
    rows, done = words.select(F.lit(0).alias("path"), "word", "n"), []
    whole = [F.lit(0).cast("long").alias(c) for c in ("low", "high", "own")]
    for depth in range(DEPTH):
        entries = keep(rows.mapInArrow(_split(paths), "key bigint, path int, word string, n bigint"))
        sizes = keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block))
        done.append(entries.join(sizes, "key", "left_anti").select("key", *whole, "path", "word", "n"))
        if sizes.isEmpty():
            break
        large = entries.join(sizes, "key")
        if depth == DEPTH - 1:
            slices = F.ceil(F.col("size") / block)
            dealt = large.select("*", F.pmod(F.xxhash64("word"), slices).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("other"))
            done.append(dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "path", "word", "n"))
        rows = large.select("path", "word", "n")
    return reduce(DataFrame.unionByName, done)


# --- inside a block ------------------------------------------------------------------------------------------------------------


def _close(gram: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows sorted by length whose letter counts lie within a squared distance of two.

    Rows of a strip meet all rows behind them of their own length and of the next.
    """
    square = (gram * gram).sum(axis=1, keepdims=True)
    one = np.ones_like(square)
    left, right = np.hstack([gram, square, one]), np.hstack([-2 * gram, one, square]).T.copy()
    ends = np.searchsorted(lengths, lengths + 1, side="right")
    edges = np.append(np.flatnonzero(np.diff(lengths, prepend=-1)), len(lengths))
    for low, high in zip(edges[:-1], edges[1:]):
        for at in range(low, high, STRIP):
            to, end = min(at + STRIP, high), ends[low]
            found = np.flatnonzero((left[at:to] @ right[:, at:end]).ravel() < 2.5)
            i, j = found // (end - at) + at, found % (end - at) + at
            yield i[i < j], j[i < j]


def _one_edit(grid: np.ndarray, flush: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j, of one length or j a letter longer, are exactly one edit apart.

    `grid` has the words' letters from the left, `flush` from the right: an inserted letter leaves a common start and a
    common end that together make up the shorter word.
    """
    ahead = grid[i] == grid[j]
    valid = np.arange(grid.shape[1]) < lengths[i][:, None]
    unlike = (~ahead & valid).sum(axis=1)
    start = np.argmin(ahead & valid, axis=1)  # an unlike or a padding place follows: the grid is one wider than any word
    behind = (flush[i] == flush[j]) & valid
    end = np.argmin(behind, axis=1)
    return np.where(lengths[i] == lengths[j], unlike == 1, start + end >= lengths[i])


def _near(words: pa.Array, n: np.ndarray, own: np.ndarray, across: bool, earlier: list[np.ndarray], column: np.ndarray) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best): the near words of one block, whose words are sorted."""
    codes, lengths = _coded(words)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - starts[row]
    width = int(lengths.max()) + 1
    gram = np.bincount(row * COLUMNS + column[codes], minlength=len(lengths) * COLUMNS).reshape(-1, COLUMNS).astype(np.float32)
    grid, flush = np.zeros((len(lengths), width), np.uint8), np.zeros((len(lengths), width), np.uint8)
    grid[row, place], flush[row, lengths[row] - 1 - place] = codes, codes
    sums = [_sums(codes, starts, letters) for letters in earlier]
    a, b = [], []
    for i, j in _close(gram[order], lengths[order]):
        for at in range(0, len(i), 1 << 16):
            x, y = order[i[at : at + (1 << 16)]], order[j[at : at + (1 << 16)]]
            good = own[x] != own[y] if across else np.ones(len(x), bool)
            for s in sums:
                good &= s[x] != s[y]
            x, y = x[good], y[good]
            near = _one_edit(grid, flush, lengths, x, y)
            a.append(x[near]), b.append(y[near])
    if not sum(map(len, a)):
        return None
    left, right = np.concatenate(a + b), np.concatenate(b + a)
    best = np.lexsort((right, -n[right], left))  # words are sorted, so a smaller row is a smaller word
    left, right = left[best], right[best]
    first = np.flatnonzero(np.diff(left, prepend=-1))
    counts = np.diff(np.append(first, len(left)))
    columns = [words.take(pa.array(left[first])), pa.array(counts.astype(np.int64)), pa.array(n[right[first]]), words.take(pa.array(right[first]))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _blockwise(paths: Paths) -> Callable:
    """Block after block of rows (key, low, high, own, path, word, n) sorted by block and word; holds one batch and one block."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            change = np.zeros(len(table), bool)
            for c in ("key", "low", "high", "path"):
                values = table[c].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            edges = [0, *np.flatnonzero(change)]
            for low, high in zip(edges[:-1], edges[1:]):
                yield table.slice(low, high - low)
            rest = table.slice(edges[-1])
        if rest is not None:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in parts(batches):
            if len(table) < 2:
                continue
            low, high, path = (table[c][0].as_py() for c in ("low", "high", "path"))
            words = table["word"].combine_chunks()
            words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
            found = _near(words, table["n"].to_numpy(), table["own"].to_numpy(), low != high, paths.earlier(path), paths.column)
            if found is not None:
                yield found

    return run


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of every word (word, n) with a near word; `best` has the largest n, then is the smallest."""
    with scratch(words.sparkSession) as keep:
        paths = Paths(letter_order(words))
        entries = blocks(words, paths, keep, block)
        sorted_ = entries.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "path", "word")
        found = sorted_.mapInArrow(_blockwise(paths), "word string, n_near bigint, best_n bigint, best string")
        best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
        summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
        return cut_lineage(summed.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best")))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the end of each chain of forms, whose known length doubles in every round.

    A form is `RATIO` times as frequent as its word, so chains end and are short.
    """
    roots = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = roots.join(on, "root", "left")
        moved = cut_lineage(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of `letters` letters or more that occurs `least` times or more.

    A word's form is its near word of largest n (ties: the smallest), if that is at least `ratio` times its own n; `root`
    follows the forms to the last. Letters are A-Z, taken as a-z, and U+00C0 to U+00FF as they are.

    A null text has no words; a null key counts as the empty text in the CRC-32. Repeated rows count repeatedly. An empty
    table gives no rows. Texts are taken whole, and no block is a task of more than two slices. Only the named columns are read.
    """
    words = cut_lineage(counted_words(docs, key, text, letters, least))
    near = neighbours(words, block)
    good = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    formed = cut_lineage(joined)
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
