"""Exact and near duplicates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusflow.functions import text as T
from corpusflow.operators.lexical import explode_once
from corpusflow.operators.shared import as_it_is, bitmap, known
from corpusflow.session import MAX_BROADCAST_ROWS, cut_lineage, scratch, within


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", lower: bool = False) -> DataFrame:
    """First row of every distinct stripped text.

    The first key of each group comes from a min aggregate, which combines before the shuffle, so a text copied into a
    third of all rows costs one partial row per task; a window over the group would sort it in one task.
    """
    normal = T.strip(F.col(text))
    digest = F.sha2(F.lower(normal) if lower else normal, 256)
    first = docs.groupBy(digest.alias("_digest")).agg(F.min(key).alias(key)).select(key)
    return docs.join(first, key, "left_semi")


def clean_batch(docs: DataFrame, key: str = "doc_id", text: str = "text", search: bool = True) -> DataFrame:
    """Batch pipeline: clean, normalise, optionally optimise for search, then keep the first of equal results.

    A text is cleaned once: a filter on the plain column would do it again, and duplicates, which read the results twice, are
    looked for in the kept ones.
    """
    content = T.normalize_punctuation(T.clean_patterns(F.col(text), preserve_structure=not search))
    if search:
        content = T.optimize_for_search(content)
    cleaned = explode_once(docs.filter(T.strip(F.col(text)) != "").select(key, F.array(content).alias("o")), "o", "out")
    return drop_exact_duplicates(cut_lineage(cleaned.filter(T.strip(F.col("out")) != "")), key, "out", lower=True)


# --- near duplicates ---------------------------------------------------------------------------------------------------------

MOST = 1 << 20  # words whose frequency the order knows, the most frequent ones


def _word_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct normalised text: (id, n, size, words), the smallest key standing for its exact copies."""
    normal = T.normalize_whitespace(F.lower(F.col(text)))
    filled = docs.select(F.col(key).alias("id"), normal.alias("t")).filter(F.col("t") != "")
    first = filled.groupBy(F.sha2("t", 256).alias("h")).agg(F.min_by("t", "id").alias("t"), F.min("id").alias("id"))
    words = F.array_distinct(F.split("t", " "))
    return first.select("id", F.length("t").alias("n"), words.alias("words")).withColumn("size", F.size("words"))


def _frequencies(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the MOST most frequent words of rows (c), sorted, and in how many rows each is; the others come before them all."""
    counts = cut_lineage(codes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    by_count = counts.groupBy("n").count().orderBy(F.desc("n"))  # as many rows as there are different counts
    above, least = 0, 2
    for row in by_count.toLocalIterator():
        above += row["count"]
        if above > MOST:
            least = row["n"] + 1
            break
    often = counts.filter(F.col("n") >= least).toArrow()
    order = np.argsort(often["c"].to_numpy())
    return often["c"].to_numpy()[order], often["n"].to_numpy()[order]


def _bits(codes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap of each list of hashes: a bit for each remainder by a power of two, two to four times the length of the list."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    width = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    flags = np.zeros(begin[-1], bool)
    flags[begin[row] + (codes & (width[row] - 1))] = True
    packed = np.packbits(flags, bitorder="little").tobytes()
    return [packed[i:j] for i, j in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist())]


PARITIES = ["k0", "k1", "k2", "k3"]


def _parities(codes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """256 bits for each list of hashes, as four numbers: whether an odd number of them has a remainder. Each hash that one
    list has and another has not changes one bit."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    odd = (np.bincount(row * 256 + ((codes >> 32) & 255), minlength=256 * len(sizes)) & 1).astype(np.uint8)
    bits = np.packbits(odd.reshape(-1, 256), axis=1, bitorder="little").view(np.int64)
    return [np.ascontiguousarray(bits[:, i]) for i in range(len(PARITIES))]


def _rare_first(sets: DataFrame, threshold: float) -> DataFrame:
    """Adds `prefix`, the hashes of the words of a set that any similar set must share one of, rarest first, and `bits`.

    A set of s words with overlap threshold t shares a word among its first s - ceil(t s) + 1 words in one global order, here
    of all words by their frequency. Any order that all rows share is exact; words beyond those that the table of
    frequencies holds are the rarest, in the order of their hashes. The order is applied inside the row.

    `bits` are those of `_bits`.
    """
    coded = sets.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    known, counts = _frequencies(explode_once(coded.select("codes"), "codes", "c"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("codes"))
            codes, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(batch)), sizes)
            often = np.zeros(len(codes), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                often = np.where(known[at] == codes, counts[at], 0)
            order = np.lexsort((codes, often, row))
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
            held = place < keep[row]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[held], minlength=len(batch)))])
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes[order][held]))
            bits = pa.array(_bits(codes, sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), prefix, bits], ["id", "n", "words", "size", "prefix", "bits"])

    rows = coded.select("id", "n", "words", "size", "codes")
    return rows.mapInArrow(ordered, f"id {dict(sets.dtypes)['id']}, n int, words array<string>, size int, prefix array<bigint>, bits binary")


def _bucketed(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, w, n, size, left): bucket entries of a row, one per prefix word in its own size band and in the next.

    Bands are a factor of the threshold wide, so the sizes of similar sets are at most one band apart and meet in a bucket.
    `left` counts the words from this one to the end of the set: no pair that meets here has more in common, unless it met
    at an earlier word.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    placed = sets.select("id", "n", "size", F.posexplode("prefix").alias("place", "word"), band.alias("band"))
    both = placed.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    return both.select("id", F.xxhash64("word", "band").alias("w"), "n", "size", (F.col("size") - F.col("place")).alias("left"))


def _similar(threshold: float):
    """Condition between rows a (earlier) and b: comparable lengths and enough common words."""
    na, nb = F.col("a.n"), F.col("b.n")
    near = F.abs(na - nb) <= F.greatest(na, nb) * (1 - threshold)
    common = F.size(F.array_intersect("a.words", "b.words"))
    return near & (common / (F.col("a.size") + F.col("b.size") - common) >= threshold)


def _bits_apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits each two bitmaps differ; of two lengths the longer is folded to the shorter."""
    out = np.zeros(len(left), np.int64)
    shapes = np.array([(len(a), len(b)) for a, b in zip(left, right)]).reshape(-1, 2)
    for shape in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == shape).all(axis=1))
        least = shape.min()
        sides = [np.frombuffer(b"".join([side[i] for i in rows]), np.uint8).reshape(len(rows), -1, least) for side in (left, right)]
        a, b = (np.bitwise_or.reduce(side, axis=1) for side in sides)
        out[rows] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


def _by_bits(tried: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The tried (id, lead) pairs whose bitmaps do not exclude that they are similar.

    Sets differ in at least as many words as their bitmaps do in bits, and similar ones of a and b words in at most
    (1 - t) / (1 + t) of a + b. So pairs are shuffled with bitmaps, not with texts, and few are left.
    """
    a, b = (sets.select(F.col("id").alias(f"{s}_id"), F.col("size").alias(f"{s}_size"), F.col("bits").alias(f"{s}_bits")) for s in "ab")
    kind = dict(tried.dtypes)["id"]

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _bits_apart(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            words = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            yield batch.select(["id", "lead"]).filter(pa.array(apart <= words * (1 - threshold) / (1 + threshold) + 1e-9))

    joined = tried.join(a, F.col("a_id") == F.col("lead")).join(b, F.col("b_id") == F.col("id"))
    return joined.select("id", "lead", "a_size", "b_size", "a_bits", "b_bits").mapInArrow(passing, f"id {kind}, lead {kind}")


def _verified(tried: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The tried (id, lead) pairs, lead before id, that are similar."""
    left = cut_lineage(_by_bits(tried, sets, threshold))
    body = sets.select("id", "n", "size", "words")
    if within(left, MAX_BROADCAST_ROWS):  # few: only their words are shuffled
        ids = left.select("id").unionByName(left.select(F.col("lead").alias("id"))).distinct()
        body = body.join(F.broadcast(ids), "id", "left_semi")
    joined = left.join(body.alias("a"), F.col("a.id") == F.col("lead")).join(body.alias("b"), F.col("b.id") == left["id"])
    return joined.filter((F.col("lead") < left["id"]) & _similar(threshold)).select(left["id"].alias("id"), "lead")


# A pair differs in at most H words, so of M segments, by hash, of all words at least M - H are equal in both sets.

LADDER = [2]  # numbers of segments
while LADDER[-1] < 1 << 40:
    LADDER.append(-(-3 * LADDER[-1] // 2))
WINDOW, LOCAL, FREQUENT = 1 << 22, 3, 8  # words that a task counts at once; in so many rows of those, and of all, a word is counted


def _counts(kind: str) -> Callable:
    """(id, h, c, n): id and holder of each row (id, h, codes), and words c that n rows of a window have, with id and h null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def frequent(like: pa.DataType) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            values, n = values[n >= LOCAL], n[n >= LOCAL]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([none.cast(like), none, pa.array(values), pa.array(n)], ["id", "h", "c", "n"])

        for batch in batches:
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none, none], ["id", "h", "c", "n"])
            held.append(batch.column(2).flatten().to_numpy())
            count += len(held[-1])
            if count >= WINDOW:
                yield frequent(batch.column(0).type)
                held, count = [], 0
        if count:
            yield frequent(batch.column(0).type)

    return run


class Segments:
    """Signatures of a row's segments, such that any two similar rows have one in common.

    For sets of a and b words H is (1 - t) / (1 + t) of a + b, and M the first number of the ladder from 1.5 (H + 1). Two equal segments
    have one signature. In one order of all signatures a row keeps the first Hmax + 1, Hmax for its partners with this M: of the M - H
    or more that a pair shares, the first one has no more than H others before it in either row. The order puts those with rare
    words first, so what rows share by chance, empty segments or frequent words, is at the end. A row has one or two M.
    """

    def __init__(self, words: np.ndarray, weights: np.ndarray, most: int, threshold: float):
        self.words, self.weights, self.most, self.threshold = words, weights, most, threshold

    def _apart(self, words: int) -> int:
        return int((1 - self.threshold) / (1 + self.threshold) * words + 1e-9)

    def of(self, codes: np.ndarray) -> np.ndarray:
        size, weights = len(codes), np.full(len(codes), self.most)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
            weights = np.where(self.words[at] == codes, self.weights[at], self.most)
        low = self._apart(size + math.ceil(size * self.threshold - 1e-9))
        high = self._apart(size + int(size / self.threshold + 1e-9))
        codes, out = codes.view(np.uint64), []
        for m in LADDER[bisect_left(LADDER, 1.5 * (low + 1)) : bisect_left(LADDER, 1.5 * (high + 1)) + 1]:
            keep = min(high + 1, 2 * m // 3)
            segment = ((codes >> np.uint64(16)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            first = np.flatnonzero(np.diff(segment[order], prepend=-1))
            content = np.zeros(m, np.uint64)
            content[segment[order[first]]] = np.add.reduceat(codes[order], first)
            names = content + (np.arange(m, dtype=np.uint64) << np.uint64(32) | np.uint64(m)) * np.uint64(0x9E3779B97F4A7C15)
            names = (names ^ (names >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            names ^= names >> np.uint64(32)
            out.append(names[np.lexsort((names, -np.bincount(segment, weights, minlength=m)))[:keep]])
        return np.concatenate(out)

    def signed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(signature, h) of rows (h, codes)."""
        for batch in batches:
            holders, found, count = [], [], 0
            for h, codes in zip(batch.column(0).to_pylist(), _lists(batch.column(1))):
                found.append(self.of(codes))
                holders.append(h)
                count += len(found[-1])
                if count >= 1 << 19:
                    yield _signatures(found, holders)
                    holders, found, count = [], [], 0
            if found:
                yield _signatures(found, holders)

    def met(self, bits: np.ndarray, copied: np.ndarray) -> Callable:
        """(id, h, w, several) of rows (id, h, codes) that have signatures `w` which the filter knows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared = [w[known(bits, w)].view(np.int64) for w in map(self.of, _lists(batch.column(2)))]
                some = np.flatnonzero([len(w) for w in shared])
                lists = [shared[i] for i in some]
                ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                w = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
                rows = batch.take(pa.array(some))
                several = pa.array(known(copied, rows.column(1).to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), w, several], ["id", "h", "w", "several"])

        return run


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, bits, k0, ...) of rows (id, t, codes)."""
    for batch in batches:
        codes, sizes = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
        columns = [batch.column(0), batch.column(1), pa.array(_bits(codes, sizes), pa.binary()), *map(pa.array, _parities(codes, sizes))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "t", "bits", *PARITIES])


def _lists(lists: pa.ListArray) -> Iterator[np.ndarray]:
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return (values[low:high] for low, high in zip(ends[:-1], ends[1:]))


def _signatures(found: list[np.ndarray], holders: list[int]) -> pa.RecordBatch:
    owners = np.repeat(np.array(holders, np.int64), [len(w) for w in found])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(owners)], ["w", "h"])


def _coded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, t, codes): the rows with words, their normalised texts with a hash, and the hashes of their words."""
    normal = T.normalize_whitespace(F.lower(F.col(text)))
    filled = explode_once(docs.select(F.col(key).alias("id"), F.array(normal).alias("o")), "o", "t").filter("t <> ''")
    h = F.conv(F.substring(F.sha2("t", 256), 1, 15), 16, 10).cast("bigint")
    codes = F.transform(F.array_distinct(F.split("t", " ")), lambda w: F.xxhash64(w))
    return filled.select("id", h.alias("h"), "t", codes.alias("codes"))


def _meetings(docs: DataFrame, threshold: float, key: str, text: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(id) of every distinct normalised text, the smallest key of its exact copies; and (id, w) for each of its segments that
    other texts have too. Texts are not shuffled.
    """
    kind, coded = dict(docs.dtypes)[key], _coded(docs, key, text).drop("t")
    made = keep(coded.mapInArrow(_counts(kind), f"id {kind}, h bigint, c bigint, n bigint"))
    rows = made.filter("h is not null").select("id", "h")
    often = made.filter("c is not null").groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "c").limit(MOST).toArrow()
    order, total = np.argsort(often["c"].to_numpy()), max(rows.count(), FREQUENT)
    weigh = lambda n: np.round(16 * np.log2(1 + total / n)).astype(np.int64)
    segments = Segments(often["c"].to_numpy()[order], weigh(often["n"].to_numpy()[order]), int(weigh(np.array(FREQUENT / 2))), threshold)

    copied = bitmap(rows.select("h"), as_it_is, keep)  # what several rows have
    shared = bitmap(coded.select("h", "codes"), segments.signed, keep, copied)
    met = keep(coded.mapInArrow(segments.met(shared, copied), f"id {kind}, h bigint, w array<bigint>, several boolean"))
    once = met.filter("several").groupBy("h").agg(F.min("id").alias("id"), F.first("w").alias("w")).select("id", "w")
    entries = keep(met.filter("not several").select("id", "w").unionByName(once).select("id", F.explode("w").alias("w")))
    return keep(rows.groupBy("h").agg(F.min("id").alias("id")).select("id")), keep(_met(entries))


def _sets_of(docs: DataFrame, ids: DataFrame, key: str, text: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, n, size, words, bits, k0, ...) of the rows with these ids and of a few others; no text is shuffled."""
    bits = bitmap(ids.select(F.xxhash64("id").alias("id")), as_it_is, keep, least=1)

    @F.arrow_udf(BooleanType())
    def wanted(hashes: pa.Array) -> pa.Array:
        return pa.array(known(bits, hashes.to_numpy().view(np.uint64)))

    coded = _coded(docs.filter(wanted(F.xxhash64(key))), key, text).select("id", "t", "codes")
    marked = coded.mapInArrow(_with_bits, f"id {dict(docs.dtypes)[key]}, t string, bits binary, {', '.join(f'{k} bigint' for k in PARITIES)}")
    words = F.array_distinct(F.split("t", " "))
    return keep(explode_once(marked.select("id", F.length("t").alias("n"), "bits", *PARITIES, F.array(words).alias("o")), "o", "words").withColumn("size", F.size("words")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keeper): greedy keep-first near-duplicate removal; keeper is null for kept rows, else the kept row that removed it.

    A row goes when an earlier kept row has comparable length and word-set Jaccard of at least the threshold. Similar rows share
    a segment; most rows share none and stay where they are.

    Rounds: a row that is the smallest undecided id of all its buckets has no earlier undecided neighbour, so it is kept,
    and everything in those buckets is compared with it alone.  A round therefore makes at most one pair per bucket entry,
    however large a group of copies is.  Rounds go on while each takes a tenth of the entries or more; then the pairs left
    in the buckets are verified once and the same rule runs on the verified pairs.  Both ways are exact.
    """
    with scratch(docs.sparkSession) as keep:
        rows, index = _meetings(docs, threshold, key, text, keep)
        ids = keep(index.select("id").distinct())
        sets = _sets_of(docs, ids, key, text, keep)
        alone = keep(rows.join(ids, "id", "left_anti"))
        decided, entries, before = [alone.select("id", F.lit(None).cast("bigint").alias("keeper"))], index.count(), math.inf
        while entries and entries <= 0.9 * before:
            before = entries
            leads = index.groupBy("w").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
            led = keep(index.join(leads, "w", "left").select("id", "w", F.coalesce("lead", "id").alias("lead")))
            first = led.groupBy("id").agg(F.min((F.col("id") == F.col("lead")).cast("int")).alias("first")).filter("first = 1").select("id")
            kept = keep(first)
            followers = led.filter(F.col("id") != F.col("lead")).select("id", "lead").distinct()
            tried = followers.join(kept.withColumnRenamed("id", "lead"), "lead", "left_semi").select("id", "lead")
            dropped = keep(_matches(tried, sets, threshold))
            decided += [kept.select("id", F.lit(None).cast("bigint").alias("keeper")), dropped]
            gone = kept.select("id").unionByName(dropped.select("id"))
            left = keep(index.join(gone, "id", "left_anti"))
            keep.drop(led), keep.drop(index)
            index, entries = left, left.count()
        last = index.join(sets.select("id", "n", "size", *PARITIES), "id")
        rest = _keep_first(keep(index.select("id").distinct()), cut_lineage(_pairs_within(last, sets, threshold)))
        return cut_lineage(reduce(DataFrame.unionByName, [*decided, rest]).select(F.col("id").alias(key), "keeper"))


def _met(index: DataFrame) -> DataFrame:
    """The entries of buckets that several rows are in."""
    return index.join(index.groupBy("w").count().filter("count > 1").select("w"), "w", "left_semi")


def _matches(tried: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, keeper) for the tried (id, lead) pairs that are similar; the smallest lead wins."""
    return _verified(tried, sets, threshold).groupBy("id").agg(F.min("lead").alias("keeper"))


def _pairs_within(index: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Verified (id, lead) pairs of undecided rows (id, w, n, size, k0, ...) that share a bucket.

    Entries bring parities of their words, so that most pairs of unlike rows end in the join that makes them: what is shuffled
    grows with the entries, not with their pairs.
    """
    earlier = index.select("w", F.col("id").alias("lead"), *[F.col(c).alias(f"l{c}") for c in ("n", "size", *PARITIES)])
    close = (F.abs(F.col("n") - F.col("ln")) <= F.greatest("n", "ln") * (1 - threshold)) & (
        F.least("size", "lsize") >= F.greatest("size", "lsize") * threshold - 1e-9
    )
    apart = reduce(Column.__add__, [F.bit_count(F.col(k).bitwiseXOR(F.col(f"l{k}"))) for k in PARITIES])
    enough = (1 + threshold) * apart <= (1 - threshold) * (F.col("size") + F.col("lsize")) + 1e-9
    tried = earlier.join(index, "w").filter((F.col("lead") < F.col("id")) & close & enough).select("id", "lead").distinct()
    return _verified(tried, sets, threshold)


def _chains(pairs: DataFrame) -> DataFrame:
    """(id, root, odd) of the rows with one earlier neighbour: the first row of its chain that has none or several, and whether
    an odd number of steps leads there.  The known length of a chain doubles in every round."""
    one = pairs.groupBy("id").agg(F.min("lead").alias("root"), F.count(F.lit(1)).alias("c")).filter("c = 1")
    chain = cut_lineage(one.select("id", "root", F.lit(True).alias("odd")))
    while True:
        step = chain.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("odd").alias("more"))
        joined = chain.join(step, "root", "left")
        odd = F.when(F.col("next").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("more"))
        moved = cut_lineage(joined.select("id", F.coalesce("next", "root").alias("root"), odd.alias("odd"), F.col("next").isNotNull().alias("moved")))
        chain = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return chain


def _keep_first(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, keeper): ids kept when all their earlier neighbours are dropped, dropped when one is kept.

    A round decides the rows without undecided earlier neighbours and, along whole chains of single neighbours, every
    second row; what a decided row decides goes with it.
    """
    keeper = F.lit(None).cast("bigint")
    kept, open_pairs = [rows.join(pairs.select("id").distinct(), "id", "left_anti").select("id")], pairs
    while not open_pairs.isEmpty():
        free = cut_lineage(open_pairs.select(F.col("lead").alias("id")).distinct().join(open_pairs.select("id").distinct(), "id", "left_anti"))
        chains = _chains(open_pairs).join(free.withColumnRenamed("id", "root"), "root", "left_semi")
        even = cut_lineage(chains.filter(~F.col("odd")).select("id"))
        now = free.unionByName(even)
        gone = cut_lineage(open_pairs.join(now.withColumnRenamed("id", "lead"), "lead", "left_semi").select("id").distinct())
        left = open_pairs.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "lead"), "lead", "left_anti").join(now, "id", "left_anti")
        waiting = open_pairs.select("id").distinct().join(gone, "id", "left_anti")
        open_pairs = cut_lineage(left.join(now.withColumnRenamed("id", "lead"), "lead", "left_anti"))
        kept += [even, waiting.join(open_pairs.select("id").distinct(), "id", "left_anti").join(even, "id", "left_anti")]
    stays = cut_lineage(reduce(DataFrame.unionByName, kept).distinct())
    best = pairs.join(stays.withColumnRenamed("id", "lead"), "lead", "left_semi").groupBy("id").agg(F.min("lead").alias("keeper"))
    return stays.select("id", keeper.alias("keeper")).unionByName(best.join(stays, "id", "left_anti").select("id", "keeper"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    kept = near_duplicates(docs, threshold, key, text).filter(F.col("keeper").isNull())
    return docs.join(kept, key, "left_semi")
