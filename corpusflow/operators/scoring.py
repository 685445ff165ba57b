"""Top-k of many queries over a large table without materialising query-row pairs.

Rows are scored against all queries of a block with one matrix product per Arrow batch, and every task keeps only the
best k rows per query.  What leaves a task is k rows per query, so the shuffle does not grow with the table.  Queries
travel to the tasks when a count proves them few; otherwise both sides are cut into a grid of bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import MAX_COLLECTED_QUERIES

ROWS_PER_PRODUCT = 1024
ROWS_PER_BLOCK = 20_000
QUERIES_PER_BLOCK = 1_000
RESULT = "query_id bigint, id bigint, score double"

Kernel = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _keep_best(best: list, scores: np.ndarray, ids: np.ndarray, k: int, largest: bool) -> None:
    """Merge one block of scores (rows x queries, NaN where not eligible) into the best lists of the queries."""
    keyed = np.round(-scores if largest else scores, 6)
    keyed[np.isnan(keyed)] = np.inf
    cut = np.partition(keyed, k - 1, axis=0)[k - 1] if len(keyed) > k else np.full(keyed.shape[1], np.inf)
    for q in range(keyed.shape[1]):
        rows = np.flatnonzero((keyed[:, q] <= cut[q]) & np.isfinite(keyed[:, q]))
        if len(rows):
            best[q] = sorted(best[q] + list(zip(keyed[rows, q].tolist(), ids[rows].tolist())))[:k]


def _best_rows(best: list, query_ids: np.ndarray, largest: bool) -> pd.DataFrame:
    rows = [(q, i, -s if largest else s) for q, found in zip(query_ids.tolist(), best) for s, i in found]
    return pd.DataFrame(rows, columns=["query_id", "id", "score"]).astype(
        {"query_id": "int64", "id": "int64", "score": "float64"}
    )


def _score(pdf: pd.DataFrame, queries: pd.DataFrame, kernel: Kernel, best: list, k: int, largest: bool) -> None:
    for at in range(0, len(pdf), ROWS_PER_PRODUCT):
        part = pdf.iloc[at : at + ROWS_PER_PRODUCT]
        _keep_best(best, kernel(part, queries), part["id"].to_numpy(), k, largest)


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    kernel: Kernel,
    k: int,
    largest: bool,
    max_queries: int = MAX_COLLECTED_QUERIES,
) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of every query.

    `rows` carries a bigint `id`, `queries` a bigint `query_id`; the kernel turns a slice of both into a matrix of scores.
    Scores are rounded to six places before ranking; ties go to the smaller id.
    """
    few = queries.limit(max_queries + 1).collect()
    if len(few) <= max_queries:
        block = pd.DataFrame([r.asDict() for r in few], columns=queries.columns)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list = [[] for _ in range(len(block))]
            for pdf in batches:
                _score(pdf, block, kernel, best, k, largest)
            yield _best_rows(best, block["query_id"].to_numpy(), largest)

        found = rows.mapInPandas(scan, RESULT) if len(block) else rows.sparkSession.createDataFrame([], RESULT)
    else:
        found = _grid(rows, queries, kernel, k, largest)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc() if largest else F.col("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _grid(rows: DataFrame, queries: DataFrame, kernel: Kernel, k: int, largest: bool) -> DataFrame:
    """Block nested loop: every block of rows meets every block of queries in one task of bounded size."""
    row_blocks = max(1, math.ceil(rows.count() / ROWS_PER_BLOCK))
    query_blocks = max(1, math.ceil(queries.count() / QUERIES_PER_BLOCK))
    left = rows.withColumn("_r", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    right = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    )

    def block(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        best: list = [[] for _ in range(len(wanted))]
        if len(part) and len(wanted):
            _score(part, wanted, kernel, best, k, largest)
        return _best_rows(best, wanted["query_id"].to_numpy() if len(wanted) else np.array([], "int64"), largest)

    return left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInPandas(block, RESULT)


# --- kernels ---------------------------------------------------------------------------------------------------------------


def squared_distance(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Squared Euclidean distance of `vector` columns; 2 - 2 cos for unit vectors."""
    a = np.stack(rows["vector"].to_numpy()).astype("float64")
    b = np.stack(queries["vector"].to_numpy()).astype("float64")
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def _dense(frame: pd.DataFrame, used: np.ndarray) -> np.ndarray:
    """Rows x used-terms matrix; terms no query uses are skipped."""
    lengths = frame["terms"].map(len).to_numpy()
    terms = np.concatenate([np.asarray(t, "int64") for t in frame["terms"]])
    weights = np.concatenate([np.asarray(w, "float64") for w in frame["weights"]])
    owner = np.repeat(np.arange(len(frame)), lengths)
    at = np.minimum(np.searchsorted(used, terms), len(used) - 1)
    hit = used[at] == terms
    out = np.zeros((len(frame), len(used)))
    np.add.at(out, (owner[hit], at[hit]), weights[hit])
    return out


def sparse_product(rows: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Inner product of (`terms`, `weights`) vectors; NaN where no term is shared."""
    used = np.unique(np.concatenate([np.asarray(t, "int64") for t in queries["terms"]]))
    scores = _dense(rows, used) @ _dense(queries, used).T
    scores[scores == 0.0] = np.nan
    return scores
