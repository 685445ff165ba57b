"""Suppression of repeated questions: a question is answered afresh when its last fresh answer is at least TTL old."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from corpusflow import fixed_values as V
from corpusflow.functions.folds import row_udf

STEPS = StructType([StructField("starts", ArrayType(LongType())), StructField("lasts", ArrayType(LongType()))])
MICROS = 1_000_000


def _next_fresh(times: np.ndarray, ttl: int) -> np.ndarray:
    """Index of the first event at least ttl after each event."""
    return np.searchsorted(times, times + ttl, side="left")


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The list of every row as an array."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [values[low:high] for low, high in zip(ends[:-1], ends[1:])]


def _lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    """The arrays of all rows as one array of lists."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def fresh_events(
    events: DataFrame, keys: list[str], ts: str = "ts", ttl_seconds: int = V.CACHE_TTL_SECONDS, span_seconds: int = 86_400,
    tie: str = "event_id",
) -> DataFrame:
    """Events with `fresh`: true where the key has no fresh event less than ttl before.

    Each fresh event depends on the one before it, so a key is a chain.  The chain is cut into time spans: every span is
    reduced on its own to the step function "earliest allowed time -> last fresh time"; the few steps of a key are folded
    in order; then every span is marked on its own from its entry time.  A key with a third of all events is spread over
    as many tasks as it has spans.
    """
    ttl, span = ttl_seconds * MICROS, span_seconds * MICROS
    columns = [c for c in events.columns if c not in keys]
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_c", F.floor(F.col("_t") / span))
    spans = timed.groupBy(*keys, "_c").agg(
        F.sort_array(F.collect_list(F.struct("_t", F.col(tie).alias("_tie"), F.struct(*columns).alias("row")))).alias("e")
    )
    spans = spans.withColumn("t", F.transform("e", lambda e: e["_t"]))

    @row_udf(STEPS)
    def steps(times: pa.Array, span_no: pa.Array) -> pa.Array:
        found = [_steps(t, c * span, ttl) for t, c in zip(_arrays(times), span_no.to_pylist())]
        return pa.StructArray.from_arrays([_lists([f[i] for f in found], pa.int64()) for i in (0, 1)], STEPS.names)

    @row_udf(ArrayType(LongType()))
    def entry_times(starts: pa.Array, lasts: pa.Array) -> pa.Array:
        pairs = zip(starts, lasts)  # the spans of a key
        return _lists([_entries(_arrays(s.values), _arrays(ends.values), ttl) for s, ends in pairs], pa.int64())

    @row_udf(ArrayType(BooleanType()))
    def marks(times: pa.Array, entry: pa.Array) -> pa.Array:
        return _lists([_marks(t, e, ttl) for t, e in zip(_arrays(times), entry.to_pylist())], pa.bool_())

    reduced = spans.select(*keys, "_c", steps("t", "_c").alias("s"))
    chains = reduced.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "s.starts", "s.lasts"))).alias("x"))
    entered = chains.select(
        *keys, F.transform("x", lambda x: x["_c"]).alias("c"), entry_times(F.transform("x", lambda x: x["starts"]), F.transform("x", lambda x: x["lasts"])).alias("n")
    ).select(*keys, F.explode(F.arrays_zip("c", "n")).alias("z")).select(*keys, F.col("z.c").alias("_c"), F.col("z.n").alias("entry"))
    marked = spans.join(entered, [*keys, "_c"]).withColumn("fresh", marks("t", "entry"))
    return marked.select(*keys, F.explode(F.arrays_zip("e", "fresh")).alias("z")).select(
        *keys, *(F.col(f"z.e.row.{c}").alias(c) for c in columns), F.col("z.fresh").alias("fresh")
    )


def _steps(times: np.ndarray, span_start: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lasts): the chain entered at the first event not before an allowed time ends at `lasts`."""
    follow, last = _next_fresh(times, ttl), np.empty(len(times), dtype="int64")
    for i in range(len(times) - 1, -1, -1):
        last[i] = times[i] if follow[i] == len(times) else last[follow[i]]
    entries = min(len(times), int(np.searchsorted(times, span_start + ttl, side="left")) + 1)
    change = np.append(last[1:entries] != last[: entries - 1], True)
    return times[:entries][change], last[:entries][change]


def _entries(starts, lasts, ttl: int) -> list[int]:
    """Earliest allowed time of every span of a key, in order."""
    allowed, out = np.iinfo("int64").min, []
    for s, ends in zip(starts, lasts):
        out.append(int(allowed))
        at = int(np.searchsorted(np.asarray(s), allowed, side="left"))
        if at < len(ends):
            allowed = int(ends[at]) + ttl
    return out


def _marks(times: np.ndarray, entry: int, ttl: int) -> np.ndarray:
    fresh = np.zeros(len(times), dtype=bool)
    at = int(np.searchsorted(times, entry, side="left"))
    while at < len(times):
        fresh[at] = True
        at = int(np.searchsorted(times, times[at] + ttl, side="left"))
    return fresh


def fresh_stream(
    events: DataFrame, keys: list[str], ts: str = "ts", ttl_seconds: int = V.CACHE_TTL_SECONDS, delay: str = "10 minutes"
) -> DataFrame:
    """Streaming form: one timestamp of state per key, dropped once the watermark has passed its TTL."""
    by_key = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        fresh = []
        for moment in rows[ts].astype("datetime64[us]").astype("int64"):
            due = last is None or moment - last >= ttl_seconds * MICROS
            fresh.append(due)
            last = int(moment) if due else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame({k: [v] * len(rows) for k, v in zip(keys, key)})
        yield out.assign(**{ts: rows[ts].to_numpy(), "fresh": fresh})

    return (
        events.withWatermark(ts, delay)
        .groupBy(*keys)
        .applyInPandasWithState(
            step, f"{by_key}, {ts} timestamp, fresh boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
