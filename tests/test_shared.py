"""Hashes that several holders have, as a bitmap."""

import os

import numpy as np
import pyarrow as pa

from corpusflow.llm.common import scratch
from corpusflow.operators import shared


def test_hashes_are_packed():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    data = shared.packed(values)
    assert (shared.unpacked(data, len(values)) == values).all() and len(data) < 4 * len(values)
    one = np.array([(1 << 40) - 1], np.uint64)
    assert shared.unpacked(shared.packed(one), 1) == one and shared.unpacked(shared.packed(np.zeros(3, np.uint64)), 3).tolist() == [0, 0, 0]


def test_bitmap_knows_what_several_holders_have(spark):
    rng = np.random.default_rng(3)
    tokens, holders = rng.integers(-(2**63), 2**63 - 1, 6000), np.arange(6000)
    tokens[:2000] = tokens[2000:4000]  # each of 2000 tokens twice, half of them with one holder
    holders[:1000] = holders[2000:3000]
    rows = spark.createDataFrame(list(zip(tokens.tolist(), holders.tolist())), "token bigint, holder bigint").repartition(3)
    with scratch(spark) as keep:
        copied = shared.bitmap(rows.select("holder"), shared.as_it_is, keep)
        assert shared.known(copied, holders[:1000].view(np.uint64)).all()
        held = shared.known(shared.bitmap(rows, shared.as_it_is, keep, copied), tokens.view(np.uint64))
        assert held[1000:2000].all() and held[3000:4000].all() and held[:1000].sum() + held[4000:].sum() < 150
        every = shared.bitmap(rows.select("token"), shared.as_it_is, keep, least=1)
        assert shared.known(every, tokens.view(np.uint64)).all() and np.bitwise_count(every).sum() <= 4000
        assert not shared.bitmap(rows.limit(0), shared.as_it_is, keep, copied).any()


def test_a_task_sends_few_bytes_a_hash(monkeypatch):
    """Rows of an aggregate took 11 to 13 bytes each."""
    values = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 200_000)
    batch = pa.RecordBatch.from_arrays([pa.array(values)], ["token"])
    out = list(shared._sent(shared.as_it_is, 64, None)(iter([batch])))
    assert sum(sum(b.column(1).to_pylist()) for b in out) == len(values)
    assert sum(len(d) for b in out for c in (2, 3) for d in b.column(c).to_pylist()) < 5 * len(values)


def test_a_kept_table_is_dropped_early(spark):
    with scratch(spark) as keep:
        one, two = keep(spark.range(5)), keep(spark.range(6))
        path = one.inputFiles()[0].removeprefix("file:").replace("///", "/")
        keep.drop(one)
        assert not os.path.exists(path) and two.count() == 6
