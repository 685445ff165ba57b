"""How filters interact: what each of them removes, alone and in every order, from one walk over all subsets of them.

Documents are counted by part and by the mask of the filters that they fail. A Gray code visits every subset of filters by
toggling one filter at a time: each mask cell counts its failures of active filters, a cell that gets its first one leaves
the running survivors, one that loses its last one comes back. The survivors of all subsets are stored, and a step of any
order is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SPACE_WORDS, text_of
from corpusflow.session import cut_lineage

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
COPY = 1 << FILTERS.index("E")  # the mask of the filter of repeated texts
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _bits(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def text_failures(docs: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, part, digest, mask): the failures of each row that its own text decides, and the SHA-256 of the text."""
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text_of(text).alias("body"))
    words = body.select("*", F.regexp_extract_all("body", F.lit(SPACE_WORDS), F.lit(0)).alias("words"))
    counted = words.select("*", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("unlike"))
    capitals = F.octet_length(F.regexp_replace("body", "[^A-Z]+", "")).cast("long")
    failing = [
        F.col("n") < FEWEST_WORDS,
        100 * F.col("unlike") < DISTINCT_PERCENT * F.col("n"),
        100 * capitals > CAPITAL_PERCENT * F.char_length("body").cast("long"),
        F.col("body").rlike(SIGNS),
    ]
    return counted.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), _bits(failing).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds `good` and `toxic` (0 or 1); rows without a label or a key have neither."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[
        F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))
    ])
    joined = rows.filter(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    keyless = rows.filter(F.col("doc_id").isNull()).withColumns({c: F.lit(None).cast("int") for c in ("good", "toxic")})
    return joined.unionByName(keyless).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def mask_cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows counted by part and by all filters that they fail, that of repeated texts included.

    Every row with a key fails it but the rows with the least key of their text. Those are found by a semi join on
    (text, key), so that a text with a third of all rows is no hot key; both counts are combined before they are shuffled.
    """
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = rows.join(least, ["digest", "doc_id"], "left_semi")
    keyed = F.col("doc_id").isNotNull()

    def counts(some: DataFrame, sign: int, mask: Column) -> DataFrame:
        grouped = some.groupBy("part", mask.alias("mask"), "good", "toxic").agg((sign * F.count(F.lit(1))).alias("n"))
        return grouped.select("part", "mask", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))

    copy = F.col("mask").bitwiseOR(F.lit(COPY))
    found = cut_lineage(counts(firsts, 1, F.col("mask")))
    moved = found.select("part", copy.alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    total = counts(rows, 1, F.when(keyed, copy).otherwise(F.col("mask")))
    return total.unionByName(found).unionByName(moved).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def survivors(cells: np.ndarray) -> np.ndarray:
    """For every subset of the filters what survives it; cells: (parts, masks, counts), result: (subsets, parts, counts)."""
    masks = cells.shape[1]
    alive = cells.sum(axis=1)
    states = np.zeros((masks, *alive.shape), np.int64)
    states[0] = alive
    failures, subset = [0] * masks, 0
    for step in range(1, masks):
        toggled = step & -step  # the Gray code's next subset differs in this filter alone
        subset ^= toggled
        for mask in range(masks):
            if mask & toggled and subset & toggled:
                failures[mask] += 1
                if failures[mask] == 1:
                    alive = alive - cells[:, mask]
            elif mask & toggled:
                failures[mask] -= 1
                if failures[mask] == 0:
                    alive = alive + cells[:, mask]
        states[subset] = alive
    return states


def _audited(cells: np.ndarray, names: str) -> tuple[list[str], list[np.ndarray]]:
    """The orders, and each of FIELDS as (parts, orders, steps)."""
    orders = list(permutations(range(len(names))))
    letters = np.array(orders)
    after = np.bitwise_or.accumulate(1 << letters, axis=1)
    before = after ^ (1 << letters)
    states = survivors(cells)
    lost = np.moveaxis(states[before] - states[after], 2, 0)
    failing = np.stack([cells[:, [m for m in range(cells.shape[1]) if m >> f & 1], 0].sum(axis=1) for f in range(len(names))], axis=1)
    alone = cells[:, 1 << np.arange(len(names)), 0]
    removed = lost[..., 0]
    credit = np.stack([removed[:, letters == f].sum(axis=1) for f in range(len(names))], axis=1)
    kept = np.moveaxis(states[after][..., 0], 2, 0)
    fields = [kept, removed, failing[:, letters] - removed, alone[:, letters], lost[..., 1], lost[..., 2], credit[:, letters]]
    return ["".join(names[i] for i in o) for o in orders], fields


def _walk(names: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = factorial(len(names)) * len(names)
        for whole in batches:
            for at in range(0, len(whole), 64):  # parts at a time: a part has `steps` rows
                batch = whole.slice(at, 64)
                parts, lists = batch.column(0), batch.column(1)
                cells = np.zeros((len(batch), 1 << len(names), 3), np.int64)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
                cells[row, flat.field("mask").to_numpy()] = np.stack([flat.field(c).to_numpy() for c in ("n", "good", "toxic")], axis=1)
                orders, fields = _audited(cells, names)
                columns = [
                    parts.take(pa.array(np.repeat(np.arange(len(batch)), steps))),
                    pa.array(np.tile(np.repeat(orders, len(names)), len(batch))),
                    pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(batch) * len(orders))),
                    *[pa.array(f.reshape(-1)) for f in fields],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *FIELDS])

    return run


def orders_of(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, FIELDS) of every order and step, from (part, mask, n, good, toxic); a mask's bit i is `names[i]`.

    A part is one row of at most 2^filters cells, so the parts are spread whatever their sizes. The rows grow with the
    factorial of the filters: meant for up to six or seven.
    """
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in FIELDS)
    return gathered.mapInArrow(_walk(names), schema)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """One row for each value of `part`, order of the filters A to E and step: what the step's filter does there.

    A fails a text of under 50 words, B one of few distinct words, C one of many capitals, D one with a sign of SIGNS, E
    one that a row with a smaller key has too. `kept` survive the step, `removed` go at it, `redundant` fail its filter but
    went before, `unique_fails` fail that filter alone; `good_lost` and `toxic_lost` are removed rows with such a label;
    `shapley` sums what the filter removes over all orders.

    A null text is empty, a null part the empty string. A row without a key never fails E and makes no other fail it; rows
    that repeat key and text fail alike. Of repeated labels the highest count. An empty table gives no rows. Only the named columns are read.
    """
    rows = cut_lineage(text_failures(docs, key, part, text))  # texts are read once
    return orders_of(mask_cells(cut_lineage(with_labels(rows, labels))))
