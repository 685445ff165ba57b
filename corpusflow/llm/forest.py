"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all of them, exact reranking.

Vectors get one more component that turns the largest inner product into the smallest angle. Trees of fixed depth are cut
on a bounded sample, by hyperplanes halfway between two random vectors; every vector of the table is then put into its leaf of
every tree. A query walks all trees at once: its queue always opens the branch nearest to it in any tree, until the leaves
taken hold the wanted share of the vectors. Leaves and queries meet by a join on the leaf, and inner products are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import scratch
from corpusflow.session import cut_lineage

TREES, DEPTH = 8, 4
SHARE = 0.8  # of all vectors that the leaves taken for a query hold
SAMPLE, COVER = 32_768, 4096  # vectors that the trees are cut on; those that measure the share
CHUNK = 4096  # vectors of a leaf, and queries of a leaf, that one task takes
SPARE = 8


def _valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors of the most common length without null or non-finite components, not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).filter(v.isNotNull() & F.col("vec_id").isNotNull())
    good = named.filter(finite & F.exists(v, lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("v") == (common["n"] if common else 0))


def _distinct(valid: DataFrame, most: int) -> DataFrame:
    """(v, ids): every distinct vector with its `most` smallest ids, gathered in each task first, so a vector may hold any share of the rows."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            values = np.array(batch.column(1).flatten()).reshape(len(batch), -1).astype(np.float64)
            for row, vec_id in zip(values, batch.column(0).to_pylist()):
                groups.setdefault(row.tobytes(), []).append(vec_id)
            vectors = [np.frombuffer(b) for b in groups]
            yield pa.RecordBatch.from_arrays([pa.array(vectors, schema.field(0).type), pa.array([sorted(set(i))[:most] for i in groups.values()], schema.field(1).type)], schema=schema)

    parts = valid.select(F.col("vec_id").cast("bigint"), F.col("v")).mapInArrow(gather, "v array<double>, ids array<bigint>")
    return parts.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


class Forest:
    """Random-projection trees over vectors with the added component; leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, top: float, trees: int, depth: int, share: float, least: int, seed: int = 11):
        self.top, self.trees, self.depth, self.share, self.least = top, trees, depth, share, least
        rng = np.random.default_rng(seed)
        points = self.lifted(sample)
        size = (1 << depth) - 1
        self.planes = np.zeros((trees, size, points.shape[1]))
        self.cuts = np.zeros((trees, size))
        for t in range(trees):
            members = {0: np.arange(len(points))}
            for node in range(size):
                own = members.pop(node)
                a, b = points[rng.choice(own, 2)] if len(own) else rng.normal(size=(2, points.shape[1]))
                plane = a - b if np.any(a != b) else rng.normal(size=points.shape[1])
                self.planes[t, node] = plane / np.linalg.norm(plane)
                side = points[own] @ self.planes[t, node]
                self.cuts[t, node] = np.median(side) if len(own) else 0.0
                right = side >= self.cuts[t, node]
                members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
        chosen = self.leaves(sample[:COVER])
        self.cover = np.zeros((trees << depth, len(chosen)), bool)
        for t in range(trees):
            self.cover[chosen[:, t], np.arange(len(chosen))] = True

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree."""
        points, out = self.lifted(x), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + ((points * self.planes[t, at]).sum(1) >= self.cuts[t, at])
            out[:, t] = at - ((1 << self.depth) - 1) + (t << self.depth)
        return out

    def search(self, query: np.ndarray) -> list[int]:
        """Leaves for a query, in the order in which the shared queue opens them, until they hold the wanted share."""
        point = np.append(query / np.linalg.norm(query), 0.0)
        margins = self.planes @ point - self.cuts
        heap = [(0.0, t, 0) for t in range(self.trees)]
        covered, taken, first = np.zeros(self.cover.shape[1], bool), [], (1 << self.depth) - 1
        want = max(self.share * len(covered), min(len(covered), self.least))
        while heap and covered.sum() < want:
            far, t, node = heapq.heappop(heap)
            if node >= first:
                leaf = node - first + (t << self.depth)
                taken.append(leaf)
                covered |= self.cover[leaf]
                continue
            margin = margins[t, node]
            near = 2 * node + 1 + (margin >= 0)
            heapq.heappush(heap, (far, t, near))
            heapq.heappush(heap, (max(far, abs(margin)), t, 4 * node + 3 - near))
        return taken


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _sample(vectors: DataFrame, most: int) -> np.ndarray:
    """The vectors with the smallest hashes, at most `most`: a bounded, repeatable sample."""
    rows = vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(most).select("v").toPandas()
    return _matrix(rows["v"]) if len(rows) else np.zeros((0, 1))


def nearest(rows: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by `every`, the k nearest other rows found.

    Score: the inner product of the original vectors in double precision; larger is nearer, ties go to the smaller id.
    Equal vectors are searched once and carry their smallest ids, so any share of the rows may hold one vector.

    Vectors that are null, zero, of another length than the most common one or that hold null or non-finite components
    take no part, neither do rows without an id. A row that repeats counts once. An empty table gives no rows.

    The share of vectors that a query reads is a parameter: on vectors without any structure no index reaches a high recall
    by reading little. The work is queries times that share, cut into tasks of CHUNK vectors by CHUNK queries.
    """
    spark = rows.sparkSession
    valid = _valid(rows, key, vector)
    found = "query_id bigint, rank int, vec_id bigint, score double"
    with scratch(spark) as keep:
        vectors = keep(_distinct(valid, k + 1).withColumn("node", F.monotonically_increasing_id()))
        sample = _sample(vectors, SAMPLE)
        if not len(sample):
            return spark.createDataFrame([], found)
        top = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
        forest = Forest(sample, top, trees, depth, share, 4 * (k + 1))
        asked = valid.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("v").cast("array<double>").alias("v")).distinct()
        queries = keep(asked.join(vectors.select("v", "node"), "v").select("query_id", "node"))
        wanted = vectors.join(queries.select("node").distinct(), "node", "left_semi")

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"node": frame["node"], "first_id": frame["ids"].str[0], "v": frame["v"], "leaves": list(forest.leaves(_matrix(frame["v"])))})

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield pd.DataFrame({"node": frame["node"], "v": frame["v"], "leaves": [forest.search(v) for v in _matrix(frame["v"])]})

        stored = keep(vectors.mapInPandas(place, "node bigint, first_id bigint, v array<double>, leaves array<bigint>"))
        walked = keep(wanted.select("node", "v").mapInPandas(walk, "node bigint, v array<double>, leaves array<bigint>"))
        held = {r["leaf"]: r["count"] for r in stored.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
        asking = {r["leaf"]: r["count"] for r in walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
        parts = [(leaf, -(-held.get(leaf, 0) // CHUNK), -(-asking.get(leaf, 0) // CHUNK)) for leaf in range(trees << depth)]
        sizes = F.broadcast(spark.createDataFrame([p for p in parts if p[1] and p[2]], "leaf bigint, chunks int, blocks int"))  # one row per leaf

        def spread(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each row in one part of its leaf on its own side, and once for every part of the other side."""
            placed = df.withColumn("leaf", F.explode("leaves")).drop("leaves").join(sizes, "leaf")
            mine = F.pmod(F.xxhash64("node", "leaf"), F.col(own)).cast("int").alias(f"{own}_at")
            return placed.select(*[c for c in df.columns if c != "leaves"], "leaf", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"))

        def best(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(near):
                return pd.DataFrame({"node": np.array([], np.int64), "near": [], "scores": []})
            q, x = _matrix(asked["v"]), _matrix(near["v"])
            nodes, first = near["node"].to_numpy(np.int64), near["first_id"].to_numpy(np.int64)
            most = min(len(x), k + 1 + SPARE)
            nears, scores = [], []
            for low in range(0, len(q), 256):
                block = q[low : low + 256]
                rough = block @ x.T
                picks = np.argpartition(-rough, most - 1, axis=1)[:, :most] if most < len(x) else np.tile(np.arange(len(x)), (len(block), 1))
                edge = np.take_along_axis(rough, picks, 1).min(1)
                for row, own, least in zip(block, range(len(block)), edge):
                    at = np.flatnonzero(rough[own] >= least - 1e-9)  # with all ties of the last one
                    exact = np.einsum("ij,j->i", x[at], row)
                    order = np.lexsort((first[at], -exact))[: k + 1]
                    nears.append(nodes[at[order]]), scores.append(exact[order])
            return pd.DataFrame({"node": asked["node"].to_numpy(np.int64), "near": nears, "scores": scores})

        groups = ["leaf", "chunks_at", "blocks_at"]
        left, right = spread(walked, "blocks", "chunks").groupBy(*groups), spread(stored, "chunks", "blocks").groupBy(*groups)
        tops = left.cogroup(right).applyInPandas(best, "node bigint, near array<bigint>, scores array<double>")
        pairs = tops.select("node", F.explode(F.arrays_zip("near", "scores")).alias("p")).select("node", F.col("p.near").alias("near"), F.col("p.scores").alias("score")).distinct()
        named = pairs.join(vectors.select(F.col("node").alias("near"), "ids"), "near")
        order = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))
        lists = named.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list(order))), 1, k + 1).alias("near"))
        each = queries.join(lists, "node").select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)).alias("at", "n"))
        return cut_lineage(each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score")))
