"""Which hashes several holders have, as a bitmap; hashes are shuffled as packed blocks instead of rows.

A task sorts the low BITS bits of its hashes, cuts them by their lowest bits into parts and sends of each part the steps between
neighbours, in as many bits as the largest step has: about 3 bytes a hash where a row of an aggregate has 12. Hashes of holders
that come once need no holder beside them. The bitmap is put together from what each part has found, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 40  # of a hash that count here; equal ones only make more candidates
HELD = 1 << 20  # hashes that a task sorts at once
PARTS = 4096  # at most
LEAST_BITS, MOST_BITS = 18, 29  # of a bitmap's size, as powers of two
BLOCKS = "part int, n int, steps binary, holders binary"


def known(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the hashes a bitmap (words of 64 bits, a power of two) knows."""
    at = values & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as a width and the steps between them in so many bits."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    width = max(1, int(steps.max()).bit_length())
    bits = np.unpackbits(steps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width :]
    return bytes([width]) + np.packbits(bits).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width :] = np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=n * width).reshape(n, width)
    return np.cumsum(np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def as_it_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A source that has the hashes, or hashes and holders, already."""
    yield from batches


def _parts(df: DataFrame) -> int:
    """Parts, a power of two: so many that a part stays small when the tasks do."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())
    return min(PARTS, 1 << max(3, math.ceil(math.log2(tasks))))


def _blocks(values: np.ndarray, holders: np.ndarray | None, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    low = (values & np.uint64((1 << BITS) - 1)).astype(np.uint64)
    shift = np.uint64(parts.bit_length() - 1)
    place = ((low & np.uint64(parts - 1)) << np.uint64(BITS)) | (low >> shift)  # by part, then by the rest
    order = np.argsort(place, kind="stable") if holders is None else np.lexsort((holders, place))
    place = place[order]
    edges = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64) << np.uint64(BITS))
    rest = place & np.uint64((1 << BITS) - 1)
    for part in np.flatnonzero(np.diff(edges)).tolist():
        at, to = int(edges[part]), int(edges[part + 1])
        yield part, to - at, packed(rest[at:to]), b"" if holders is None else holders[order[at:to]].tobytes()


def _sent(run: Callable, parts: int, copied: np.ndarray | None) -> Callable:
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, held, count = [], [], 0

        def batch_of() -> pa.RecordBatch:
            rows = list(_blocks(np.concatenate(alone), None, parts)) if alone else []
            if held:
                values, holders = (np.concatenate(x) for x in zip(*held))
                rows += _blocks(values, holders, parts)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "n", "steps", "holders"])

        for batch in run(batches):
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if batch.num_columns == 1:
                alone.append(values)
            else:
                holders = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                several = known(copied, holders)
                alone.append(values[~several]), held.append((values[several], holders[several]))
            count += len(values)
            if count >= HELD:
                yield batch_of()
                alone, held, count = [], [], 0
        if count:
            yield batch_of()

    return sent


def _found(least: int) -> Callable:
    """The hashes of a part that come from so many holders, 1 or 2."""

    def found(rows: pa.Table) -> pa.Table:
        alone, held, holders = [np.zeros(0, np.uint64)], [], []
        for n, steps, who in zip(rows["n"].to_pylist(), rows["steps"].to_pylist(), rows["holders"].to_pylist()):
            (held if who else alone).append(unpacked(steps, n))
            if who:
                holders.append(np.frombuffer(who, np.uint64))
        if held:
            values, owners = np.concatenate(held), np.concatenate(holders)
            order = np.lexsort((owners, values))
            values, owners = values[order], owners[order]
            first = np.append(True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1]))
            alone.append(values[first])
        values = np.sort(np.concatenate(alone))
        several = np.unique(values if least == 1 else values[1:][values[1:] == values[:-1]])
        n, steps = ([len(several)], [packed(several)]) if len(several) else ([], [])
        return pa.table({"part": pa.array([rows["part"][0].as_py()] * len(n), pa.int32()), "n": pa.array(n, pa.int32()), "steps": pa.array(steps, pa.binary())})

    return found


def bitmap(source: DataFrame, run: Callable, keep: Callable[[DataFrame], DataFrame], copied: np.ndarray | None = None, least: int = 2) -> np.ndarray:
    """A bitmap of the low bits of the hashes that at least two holders have, or of all hashes with `least` 1.

    `run` makes Arrow batches (hash) or (hash, holder) of the source's batches. Without holders each hash counts as often as
    it comes. A holder that `copied` does not know gives each of its hashes once; the others are told apart by number. 16 bits for each
    hash up to 2^MOST_BITS bits: it knows all of them and few others.
    """
    parts = _parts(source)
    blocks = source.mapInArrow(_sent(run, parts, copied), BLOCKS)
    several = keep(blocks.groupBy("part").applyInArrow(_found(least), "part int, n int, steps binary"))
    count = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * count + 1))))
    own = (1 << power) // parts

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, steps in zip(*(batch.column(i).to_pylist() for i in range(3))):
                flags = np.zeros(own, bool)
                flags[unpacked(steps, n) & np.uint64(own - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["part", "flags"])

    out = np.zeros((own, parts // 8), np.uint8)  # bit `part` of a row: the hashes of a part are that far apart
    for row in several.mapInArrow(marked, "part int, flags binary").toLocalIterator():
        flags = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=own)
        out[:, row["part"] // 8] |= flags << np.uint8(row["part"] % 8)
    return out.reshape(-1).view(np.uint64)
