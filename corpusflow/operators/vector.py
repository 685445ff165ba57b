"""Vector retrieval: exact and cell-pruned top-k, diversity-aware selection and the adaptive threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusflow import fixed_values as V
from corpusflow.functions import text as T
from corpusflow.operators import scoring
from corpusflow.session import MAX_BROADCAST_ROWS, cut_lineage, within


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = V.TOP_K, key: str = "vec_id", column: str = "embedding",
    query_key: str = "query_id", query_column: str = "qvec",
) -> DataFrame:
    """(query_id, rank, vec_id, distance) by squared Euclidean distance, ascending."""
    rows = vectors.select(F.col(key).alias("id"), F.col(column).alias("vector"))
    wanted = queries.select(F.col(query_key).alias("query_id"), F.col(query_column).alias("vector"))
    top = scoring.top_k(rows, wanted, scoring.squared_distance, k, largest=False)
    return top.select(
        F.col("query_id").alias(query_key), "rank", F.col("id").alias(key), F.col("score").alias("distance")
    )


def adaptive_threshold(
    results: DataFrame, threshold: float = V.DISTANCE_THRESHOLD, score: str = "distance", query_key: str = "query_id",
    similarity: bool = False,
) -> DataFrame:
    """Keep rows better than the threshold, relaxed when no row of the query reaches it.

    With fewer than two survivors the first max(3, n // 2) rows of the query come back.  A query has at most k rows
    here, so the windows are bounded.
    """
    whole = Window.partitionBy(query_key)
    s = F.col(score)
    if similarity:
        relaxed = F.when(F.max(s).over(whole) < threshold, F.greatest(F.lit(threshold / 1.5), F.avg(s).over(whole)))
    else:
        relaxed = F.when(F.min(s).over(whole) > threshold, F.least(F.lit(threshold * 1.5), F.avg(s).over(whole)))
    limited = results.withColumn("_t", F.coalesce(relaxed, F.lit(threshold))).withColumn("_n", F.count("*").over(whole))
    passed = limited.withColumn("_ok", (s > F.col("_t")) if similarity else (s < F.col("_t")))
    passed = passed.withColumn("_kept", F.sum(F.col("_ok").cast("int")).over(whole))
    first = F.col("rank") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 2))
    return passed.filter(F.when(F.col("_kept") < 2, first).otherwise(F.col("_ok"))).drop("_t", "_n", "_ok", "_kept")


def mmr(
    vectors: DataFrame, queries: DataFrame, k: int = V.TOP_K, diversity: float = V.MMR_DIVERSITY, key: str = "vec_id",
    column: str = "embedding", query_key: str = "query_id", query_column: str = "qvec",
) -> DataFrame:
    """(query_id, rank, vec_id, distance): k of 2k nearest rows, each the best trade of relevance and novelty.

    The 2k candidates per query bound every group that reaches Python.
    """
    weight = 1.0 - diversity
    near = cut_lineage(vector_top_k(vectors, queries, 2 * k, key, column, query_key, query_column))
    few = F.broadcast(near) if within(near, MAX_BROADCAST_ROWS) else near  # counted: then the vectors stay where they are
    full = few.join(vectors.select(key, F.col(column).alias("_v")), key).join(
        queries.select(query_key, F.col(query_column).alias("_q")), query_key
    )

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        m = np.stack(group["_v"].to_numpy()).astype("float64")
        q = np.asarray(group["_q"].iloc[0], dtype="float64")
        unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        relevance = unit @ (q / max(np.linalg.norm(q), 1e-300))
        chosen = [int(np.argmax(relevance))]
        nearest = unit @ unit[chosen[0]]
        while len(chosen) < min(k, len(group)):
            gain = weight * relevance - (1.0 - weight) * nearest
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
            nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
        out = group.iloc[chosen][[query_key, key, "distance"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out[[query_key, "rank", key, "distance"]]

    return full.groupBy(query_key).applyInPandas(select, f"{query_key} bigint, rank int, {key} bigint, distance double")


def assign_cells(
    vectors: DataFrame, cells: int = 16, column: str = "embedding", seed: int = 42
) -> tuple[DataFrame, np.ndarray]:
    """Vectors with the id of their k-means cell, and the cell centres (cells x dim, bounded by the cell count)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dense = vectors.withColumn("_f", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=cells, seed=seed, featuresCol="_f", predictionCol="cell_id", maxIter=10).fit(dense)
    return model.transform(dense).drop("_f"), np.stack(model.clusterCenters())


def nearest_cells(vectors: DataFrame, centres: np.ndarray, cells: int, column: str = "embedding", name: str = "cells") -> DataFrame:
    """Adds the ids of the `cells` nearest centres, nearest first; distances count to nine places, ties go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)).astype("float64")
            d = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T
            near = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :cells].astype(np.int32)
            offsets = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(near.ravel()))], names=[*batch.schema.names, name])

    kinds = StructType([*vectors.schema.fields, StructField(name, ArrayType(IntegerType()))])
    return vectors.mapInArrow(run, kinds)


def store_cells(vectors: DataFrame, centres: np.ndarray, path: str, column: str = "embedding", files: int = 4) -> None:
    """Writes the vectors partitioned by the cell of their nearest centre, each cell in a few files."""
    celled = nearest_cells(vectors, centres, 1, column).withColumn("cell_id", F.get("cells", F.lit(0))).drop("cells")
    spread = F.pmod(F.xxhash64(F.to_json(F.struct(*[c for c in vectors.columns if c != column]))), F.lit(files))
    celled.repartition(len(centres) * files, "cell_id", spread).write.partitionBy("cell_id").parquet(path)


def cell_top_k(
    celled: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = V.TOP_K, probes: int = 4, key: str = "vec_id",
    column: str = "embedding", query_key: str = "query_id", query_column: str = "qvec",
) -> DataFrame:
    """Approximate top-k: a query looks only into its nearest cells.  Exact when every cell is probed.

    Queries and vectors meet by cell, and nothing else is multiplied.  Of a table that `store_cells` wrote, cells that no
    query probes are not read.  Cells are cut into blocks of rows and queries into blocks of queries, so that neither a
    large cell nor a cell that most queries probe is one task.
    """
    asked = nearest_cells(queries.select(F.col(query_key).alias("query_id"), F.col(query_column).alias("vector")), centres, probes, "vector")
    asked = cut_lineage(asked.withColumn("cell_id", F.explode("cells")).drop("cells"))
    probed = [r["cell_id"] for r in asked.select("cell_id").distinct().collect()]  # at most one for each centre
    rows = celled.filter(F.col("cell_id").isin(probed)).select(F.col(key).alias("id"), F.col(column).alias("vector"), "cell_id")
    sizes = rows.groupBy("cell_id").agg(F.ceil(F.count(F.lit(1)) / scoring.ROWS_PER_BLOCK).alias("row_blocks"))
    sizes = asked.groupBy("cell_id").agg(F.ceil(F.count(F.lit(1)) / scoring.QUERIES_PER_BLOCK).alias("query_blocks")).join(sizes, "cell_id")
    sizes = F.broadcast(cut_lineage(sizes))  # at most one row for each centre

    def blocks(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64(name), F.col(f"{own}_blocks")).alias(f"{own}_block")
        other_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return side.join(sizes, "cell_id").select("cell_id", name, "vector", own_block, other_block)

    def block(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        best: list = [[] for _ in range(len(wanted))]
        if len(part) and len(wanted):
            scoring._score(part, wanted, scoring.squared_distance, best, k, False)
        return scoring._best_rows(best, wanted["query_id"].to_numpy() if len(wanted) else np.array([], "int64"), False)

    keys = ["cell_id", "row_block", "query_block"]
    found = blocks(rows, "id", "row", "query").groupBy(*keys).cogroup(blocks(asked, "query_id", "query", "row").groupBy(*keys)).applyInPandas(block, scoring.RESULT)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_key), "rank", F.col("id").alias(key), F.col("score").alias("distance"))


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """(query_id, hits, recall): how many of the exact results of each question were found."""
    joined = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("hit")), [query_key, key], "left")
    return joined.groupBy(query_key).agg(F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def centroids(vectors: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """(query_id, qvec): unit-length mean vector per label; sums combine before the shuffle."""
    parts = vectors.select(label, F.posexplode(F.col(column).cast("array<double>")).alias("at", "x"))
    means = parts.groupBy(label, "at").agg(F.avg("x").alias("m"))
    rows = means.groupBy(label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("v"),
        F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"),
    )
    return rows.select(
        F.col(label).cast("bigint").alias("query_id"), F.transform("v", lambda x: x / F.col("norm")).alias("qvec")
    )


def eligible_vectors(docs: DataFrame, vectors: DataFrame, dim: int, key: str = "doc_id", vector_key: str = "vec_id") -> DataFrame:
    """(doc_id, vector, eligible): a zero vector where the cleaned text is shorter than ten characters."""
    checked = docs.select(key, T.is_valid_text(F.col("text")).alias("eligible"))
    joined = checked.join(
        vectors.select(F.col(vector_key).alias(key), F.col("embedding").cast("array<double>").alias("_e")), key
    )
    zero = F.array_repeat(F.lit(0.0), dim)
    return joined.select(key, F.when(F.col("eligible"), F.col("_e")).otherwise(zero).alias("vector"), "eligible")
