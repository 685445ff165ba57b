"""Packing documents into sequences: dominance reduction on the histogram of lengths, then best fit.

The instance is a histogram: how many pieces there are of each length up to the capacity. It has at most `capacity` entries
however many documents there are, so the reduction and the packing run on it, and what they make is a plan: bin patterns
(lengths side by side in one sequence) with how often each is used. Pieces then find their place by rank within their length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import returning_memory, text_of
from corpusflow.session import cut_lineage

CAPACITY = 2048
END_ID = 0


def ranks_tokenizer(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level vocabulary in rank form; gives the same ids as the same vocabulary's JSON form.

    Special tokens in a text are ordinary text. Loaded for each task and not kept: a waiting worker would hold it.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of every text and an end id, cut into pieces of at most `capacity`.

    A document that fits is one piece. A longer one is cut from its end into full pieces; what is left is the first.
    """
    vocabulary = vocabulary or vocabulary_path()
    fields = "piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ranks_tokenizer(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                ids = np.append(np.array(tokens(body), dtype="<u4"), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids), capacity), len(ids)]
                for number, (low, high) in enumerate(zip(edges, edges[1:])):
                    part = ids[low:high]
                    row.append(i), piece.append(number), start.append(low), length.append(high - low), crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype("int32"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], names=names)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text_of(text).alias("body")).mapInArrow(returning_memory(encode), f"doc_id bigint, {fields}")


# --- the plan ----------------------------------------------------------------------------------------------------------------


class _Counts:
    """Lengths that are left, with the largest at or below a bound in logarithmic time."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def give(self, size: int) -> None:
        if size not in self.count:
            bisect.insort(self.sizes, size)
        self.count[size] = self.count.get(size, 0) + 1

    def largest(self, bound: int) -> int:
        """The largest length left of at most `bound`, or 0."""
        at = bisect.bisect_right(self.sizes, bound)
        return self.sizes[at - 1] if at else 0

    def smallest_sum(self, k: int) -> int | None:
        """Sum of the k smallest pieces left, None when there are fewer."""
        total = 0
        for size in self.sizes:
            n = min(k, self.count[size])
            total, k = total + n * size, k - n
            if not k:
                return total
        return None


def _dominant_pair(left: _Counts, room: int, most: int) -> tuple[int, int] | None:
    """The pair (most, b) if it dominates every set of at most two pieces that fits in `room`, else None.

    `most` is the largest single piece that fits. Every other fitting set has a larger piece of at most `most`, so the pair
    dominates all of them when its second piece is no smaller than the smaller piece of any fitting pair.
    """
    spare = dict(left.count)
    spare[most] -= 1
    b = next((s for s in reversed(left.sizes[: bisect.bisect_right(left.sizes, room - most)]) if spare[s] > 0), 0)
    if not b:
        return None
    for y in reversed(left.sizes[: bisect.bisect_right(left.sizes, room // 2)]):
        if y <= b:
            return most, b
        if left.count[y] > 1 or left.largest(room - y) > y:
            return None  # a pair with both pieces above b fits
    return most, b


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello and Toth's reduction: sequences that some optimal packing holds, and what is left.

    For each length from the largest, with `room` left beside it: nothing fits, it stays alone; a piece fills the room
    exactly, or no two pieces fit and the largest single one is taken, they are fixed together; two but not three fit, and
    one single piece or one pair dominates all fitting sets, that is fixed. Each step repeats while its pieces last.
    """
    left, fixed = _Counts(dict(histogram)), []
    for size in sorted(histogram, reverse=True):
        while left.count.get(size):
            room = capacity - size
            left.take(size, 1)  # the piece that looks for partners is no partner itself
            most, two, three = left.largest(room), left.smallest_sum(2), left.smallest_sum(3)
            if not most:
                partners: tuple[int, ...] | None = ()
            elif most == room or two is None or two > room:
                partners = (most,)
            elif three is None or three > room:
                best = _largest_pair(left, room)
                partners = (most,) if most >= best else _dominant_pair(left, room, most)
            else:
                partners = None
            left.give(size)
            if partners is None:
                break
            need = Counter((size, *partners))
            n = min(left.count[s] // k for s, k in need.items())  # with fewer pieces left the same step holds again
            for s, k in need.items():
                left.take(s, n * k)
            fixed.append(((size, *partners), n))
    return fixed, dict(left.count)


def _largest_pair(left: _Counts, room: int) -> int:
    """Largest sum of two pieces that fits in `room`."""
    best, low, high = 0, 0, len(left.sizes) - 1
    while low <= high:
        total = left.sizes[low] + left.sizes[high]
        if total > room or (low == high and left.count[left.sizes[low]] < 2):
            high -= 1
        else:
            best, low = max(best, total), low + 1
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: [(lengths side by side, number of sequences)].

    Open sequences of equal content are one entry with a number, so the work depends on the number of lengths, not of pieces.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []  # rooms in use, ascending

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((pattern, n))

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = order[at]
            pattern, have = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // size, n)
            used = min(have, n // each)
            if have > used:
                put(room, pattern, have - used)
            put(room - each * size, pattern + (size,) * each, used)
            n -= used * each
    return [entry for entries in rooms.values() for entry in entries]


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_sequence, per_sequence, offset) that place every rank of every length."""
    fixed, rest = reduce_by_dominance(histogram, capacity)
    rows, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, n in fixed + best_fit(rest, capacity):
        offset, at = 0, 0
        while at < len(pattern):
            size, per = pattern[at], 1
            while at + per < len(pattern) and pattern[at + per] == size:
                per += 1
            rows.append((size, rank[size], rank[size] + n * per, sequence, per, offset))
            rank[size] += n * per
            offset, at = offset + per * size, at + per
        sequence += n
    return rows


MAX_PLAN_ROWS = 200_000


def ranks_within(rows: DataFrame, column: str) -> DataFrame:
    """Adds `rank` (from 0) among the rows of equal `column`; a value may hold any share of the rows.

    Rows are numbered within (partition, value) and shifted by what the partitions before hold, so that no value is
    sorted in one task.
    """
    kept = cut_lineage(rows.withColumn("part", F.spark_partition_id()))
    sums = kept.groupBy(column, "part").agg(F.count(F.lit(1)).alias("n"))
    left = Window.partitionBy(column).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(column, "part", F.coalesce(F.sum("n").over(left), F.lit(0)).alias("before"))
    own = Window.partitionBy(column, "part").orderBy(F.monotonically_increasing_id())
    numbered = kept.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(before, [column, "part"]).withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a `length` of 1 to `capacity`; offsets leave no gaps.

    The histogram of lengths (at most `capacity` rows) goes to the driver; the plan that comes back has a bounded number of
    rows, which is checked before it is broadcast.
    """
    spark = made.sparkSession
    ranked = cut_lineage(ranks_within(made, "length"))
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    plan = packing_plan(histogram, capacity)
    if len(plan) > MAX_PLAN_ROWS:
        raise ValueError(f"the packing plan has {len(plan)} rows; more than {MAX_PLAN_ROWS} can't come of {capacity} lengths")
    table = spark.createDataFrame(plan, "length bigint, low bigint, high bigint, first bigint, per int, place bigint")
    runs = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "first", "per", "place"))).alias("runs"))
    runs = runs.select("length", F.explode("runs").alias("run")).select("length", "run.*")
    joined = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    return joined.select(
        *[ranked[c] for c in made.columns],
        (F.col("first") + F.floor(within / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + (within % F.col("per")) * ranked["length"]).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every document in sequences of at most `capacity` ids.

    A null or empty text is its end id alone. A text of any length is encoded whole, in one row. Repeated rows are packed
    each on its own; a null key stays null. An empty table gives no rows. Only the two named columns are read.
    """
    return pack(pieces(docs, capacity, key, text, vocabulary, keep_ids), capacity)
