"""Exact top-k by integer inner product, with multi-resolution segment statistics.

A vector is cut into segments. For vectors q and x and a segment of length L with means m and deviations s,
``sum (q_i - x_i)^2 >= L ((m_q - m_x)^2 + (s_q - s_x)^2)``; as the squared norms add up from the same statistics,
this lower bound of the distance is the upper bound ``sum over segments of L (m_q m_x + s_q s_x)`` of the inner
product. Bounds are taken with 1, 4 and 16 segments, coarse to fine; a pair goes on only while its bound reaches the
query's k-th best score so far. Survivors get the exact integer product.

Queries come in blocks of a fixed number of vectors; a block is broadcast (block_rows x dimensions numbers) and every
candidate partition goes over it, keeping k rows of each query. With several blocks, each one's result is written and its
broadcast freed before the next, so the driver holds one block at a time. A block's queries are first scored against each other,
which gives each its first threshold. The k best of all partitions then meet in one window over a query's few rows.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id. Only vectors of equal length are compared. Candidates with the query's own id are left out; ids that occur
several times are candidates once for each row, and as a query once (with the smallest vector). Ties go to the smaller
id. A query without candidates has no rows. Scaled components and scores beyond the range of a long are taken as the
nearest long, so such scores tie. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.common import written

LEVELS = (1, 4, 16)
SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """k, v: ids and scaled integer components of the rows that take part."""
    ok = F.col(key).isNotNull() & (F.size(F.coalesce(F.col(vector), F.array())) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(ok).select(F.col(key).cast("long").alias("k"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


class Segments:
    """Statistics of vectors at each level, as factors whose products are upper bounds of inner products."""

    def __init__(self, values: np.ndarray):
        dim = values.shape[1]
        self.values, self.levels = values, []
        for n in LEVELS:
            if n > dim:
                break
            cuts = np.linspace(0, dim, n + 1).astype(int)
            length = np.diff(cuts)
            mean = np.add.reduceat(values, cuts[:-1], axis=1) / length
            square = np.add.reduceat(values * values, cuts[:-1], axis=1) / length
            root = np.sqrt(length)
            # deviations are rounded up a little, so that the bound holds in floating point too
            deviation = np.sqrt(np.maximum(0, square - mean * mean) + 1e-9 * (1 + square))
            self.levels.append(np.concatenate([mean * root, deviation * root], axis=1))


def pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 100_000) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def exact_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products: in floating point while every sum is below 2^53, else with whole numbers of any size."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return pair_products(q, x, i, j).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    sums = [(whole(q[i[s : s + 10_000]]) * whole(x[j[s : s + 10_000]])).sum(axis=1) for s in range(0, len(i), 10_000)]
    return np.clip(np.concatenate(sums), -(2**63), 2**63 - 1).astype(np.int64) if sums else np.zeros(0, np.int64)


class Best:
    """The k best (score, id) of each query so far, with its threshold."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor.astype(np.float64), k
        self.rows = [np.zeros(0, np.int64)] * 3

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip(self.rows, (query, ids, scores), strict=True))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], scores[last])
        self.rows = [query[keep], ids[keep], scores[keep]]


def survivors(q: Segments, x: Segments, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose bounds reach the query's threshold at every level."""
    i, j = np.nonzero(q.levels[0] @ x.levels[0].T >= floor[:, None])
    for a, b in zip(q.levels[1:], x.levels[1:], strict=True):
        keep = pair_products(a, b, i, j) >= floor[i]
        i, j = i[keep], j[keep]
    return i, j


def first_floor(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the block's other queries: no more than that among all rows."""
    floor = np.full(len(ids), -np.inf)
    if len(ids) <= k:
        return floor
    for s in range(0, len(ids), 512):
        products = values[s : s + 512] @ values.T
        products[np.arange(len(products)), np.arange(s, s + len(products))] = -np.inf
        floor[s : s + 512] = np.partition(products, -k, axis=1)[:, -k]
    # rounding in the products of very large numbers must not lift the threshold
    return floor - np.abs(floor) * 1e-9


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner products for each row where is_query holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector, scale)
    queries = usable(vectors.filter(is_query), key, vector, scale).groupBy("k").agg(F.min("v").alias("v"))
    passes: list[DataFrame] = []

    def search(shared: Broadcast) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides = {d: (ids, Segments(values), Best(first_floor(ids, values, k), k)) for d, (ids, values) in shared.value.items()}
            for batch in batches:
                size = np.diff(np.asarray(batch["v"].offsets))
                for d in np.unique(size).tolist():
                    if d not in sides:
                        continue
                    own = batch.filter(pa.array(size == d))
                    flat = np.asarray(own["v"].flatten(), dtype=np.float64).reshape(-1, d)
                    cand = np.asarray(own["k"], dtype=np.int64)
                    ids, q, best = sides[d]
                    for s in range(0, len(cand), 1024):
                        x = Segments(flat[s : s + 1024])
                        i, j = survivors(q, x, best.floor)
                        other = ids[i] != cand[s : s + 1024][j]
                        i, j = i[other], j[other]
                        best.add(i, cand[s : s + 1024][j], exact_products(q.values, x.values, i, j))
            for ids, _, best in sides.values():
                q, c, sc = best.rows
                yield pa.RecordBatch.from_pydict({"query_id": ids[q], "vec_id": c, "score": sc})

        return rows.mapInArrow(run, SCHEMA)

    def pack(block: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r["v"]) for r in block}:
            own = [r for r in block if len(r["v"]) == d]
            out[d] = np.array([r["k"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64)
        return out

    block: list = []
    for r in queries.toLocalIterator():
        if len(block) == block_rows:
            shared = spark.sparkContext.broadcast(pack(block))  # at most block_rows vectors
            passes.append(written(search(shared), "best"))
            shared.destroy()
            block = []
        block.append(r)
    last = search(spark.sparkContext.broadcast(pack(block)))
    found = reduce(DataFrame.unionByName, [*passes, written(last, "best") if passes else last])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
