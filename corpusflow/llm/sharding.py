"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import shuffle_partitions, text_of
from corpusflow.session import cut_lineage


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = text_of(text)
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.md5(body).alias("group"),
    )


def prefix_sums(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Adds `first` (bytes before the row) and `index` (rows before it) in the global order of the given columns.

    Rows are range-partitioned by the order and kept, each partition is summed, the totals (one row per partition) are
    summed up to the left, and every partition adds its own running sums to what lies before it.
    """
    n = shuffle_partitions(rows.sparkSession)
    ranged = cut_lineage(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    left = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "part", F.coalesce(F.sum("bytes").over(left), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(left), F.lit(0)).alias("rows_before")
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(before), "part")  # one row per partition
        .withColumn("first", F.col("bytes_before") + F.sum("size").over(within) - F.col("size"))
        .withColumn("index", F.col("rows_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
        .drop("part", "bytes_before", "rows_before")
    )


def _cuts(placed: DataFrame, shards: int, tolerance: float) -> list[float]:
    """Byte positions of the shards - 1 cuts, each at the nearest edge of what lies across it.

    What lies across an equal target is a group of equal texts, if that holds at most `tolerance` of a shard, else a row.
    Only the groups at the targets are looked at: one per cut.
    """
    total = placed.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    cut_no = F.floor((F.col("first") + F.col("size") - 1) / F.lit(target or 1.0))
    across = placed.filter((cut_no > F.floor((F.col("first") - 1) / F.lit(target or 1.0))) & (cut_no >= 1)).select("group").distinct()
    edges = (
        placed.join(F.broadcast(across), "group", "left_semi")  # at most shards - 1 groups
        .groupBy("group").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("size")).alias("high"), F.max("size").alias("row"))
    )
    groups = [(r["low"], r["high"], r["row"]) for r in edges.collect()]
    cuts = []
    for k in range(1, shards):
        at = k * target
        low, high, row = next((g for g in groups if g[0] < at < g[1]), (at, at, 0))
        if high - low > max(tolerance * target, row):
            steps = (at - low) // row  # equal texts have equal sizes: the edges of the row across the target
            low, high = low + steps * row, low + (steps + 1) * row
        cuts.append(low if at - low <= high - at else high)
    return cuts


def _above(first: Column, cuts: list[float]) -> Column:
    return reduce(lambda total, cut: total + (first >= F.lit(float(cut))).cast("int"), cuts, F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.01) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row in one of `shards` contiguous shards of nearly equal bytes.

    The order is that of the texts' digests, then of the keys, so equal texts lie together; a cut moves to the edge of
    the group of equal texts across it, but splits a group of more than `tolerance` of a shard, which may be a third of
    all rows.  `slot` counts the rows of a shard from 0.  Law `bytes`: `grown_shard` is null.

    A null text counts as empty (size 1).  Repeated rows each get a slot of their own, in any order among themselves; null
    keys sort first.  An empty table gives no rows.  Only the two named columns are read, so others may have any name.
    """
    placed = cut_lineage(prefix_sums(_rows(docs, key, text), ("group", "doc_id")))
    sharded = placed.withColumn("shard", _above(F.col("first").cast("double"), _cuts(placed, shards, tolerance)))
    starts = sharded.groupBy("shard").agg(F.min("index").alias("start"))
    return sharded.join(F.broadcast(starts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("index") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
