"""Approximate nearest neighbours by query-aware collision counting.

Every block of vectors keeps ``m`` sorted arrays, one per random projection.
A query opens a window around its own projection in each array; a vector
collides once per window that holds it. Windows widen by virtual rehashing
(radius times ``step``, the same arrays) until enough vectors have reached the
collision threshold; those are verified by exact distance. ``m``, the window
width and the threshold follow from the success and false-positive rates of
the query-aware scheme (Gaussian projections, approximation ratio ``c``).

Blocks are visited in parallel and each returns its own best ``k + 1``
distinct vectors, so the merge sees a bounded number of rows per query and
block. Equal vectors are one entry that carries its ``k + 1`` smallest ids,
which is all a top-k can use.

Vectors without structure (as in the test tables: 64 independent numbers) need
a quarter of a block verified for a recall of 0.95; ``BUDGET`` is that share,
not the ``FALSE_RATE`` that the number of arrays follows from.

Defined results: vectors that are null, zero, empty or hold null or
non-finite components take no part; repeated rows count once; a vec_id with
several vectors is a candidate by its nearest one, and a query by each, of
which the nearest results stay; ties go to the smaller vec_id; vectors of
another dimension are not compared; vectors of any dimension are projected
whole; only the id and vector columns are read, so others may have any name;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import load, materialize

BLOCK_ROWS = 8192
#: False-positive rate that the number of projections is derived from.
FALSE_RATE = 0.02
#: Share of a block that may reach the threshold before windows stop to widen.
BUDGET = 0.25


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col("vec")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).where(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )


def scheme(n: int, false_rate: float, c: float = 2.0, error: float = 1 / math.e) -> tuple[int, int, float]:
    """Number of projections, collision threshold and window width at radius 1."""
    phi = NormalDist().cdf
    w = math.sqrt(8 * c * c * math.log(c) / (c * c - 1))
    p1, p2 = 2 * phi(w / 2) - 1, 2 * phi(w / (2 * c)) - 1
    beta = max(false_rate, 1 / max(n, 1))
    a, b = math.sqrt(math.log(2 / beta)), math.sqrt(math.log(1 / error))
    m = math.ceil((a + b) ** 2 / (2 * (p1 - p2) ** 2))
    z = a / b
    return m, math.ceil((z * p1 + p2) / (1 + z) * m), w


class Block:
    """Sorted projection arrays over one block of distinct vectors."""

    def __init__(self, vecs: np.ndarray, ids: list[list[int]], budget: float, seed: int = 7):
        self.vecs, self.ids, self.budget = vecs, ids, budget
        n, dim = vecs.shape
        self.m, self.threshold, self.w = scheme(n, FALSE_RATE)
        self.axes = np.random.default_rng(seed + dim).standard_normal((dim, self.m))
        proj = (vecs @ self.axes).T
        self.order = np.argsort(proj, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(proj, self.order, 1)
        self.first = np.fromiter((x[0] for x in ids), np.int64, n)
        spread = np.median(np.abs(self.values - np.median(self.values, axis=1, keepdims=True))) / 0.6745
        self.unit = max(float(spread), 1e-12) * 0.25

    def search(self, q: np.ndarray, k: int, step: float = 1.25) -> list[tuple[int, float]]:
        n = len(self.vecs)
        enough = min(n, k + 1 + math.ceil(self.budget * n))
        at = q @ self.axes
        hits = np.zeros(n, np.int64)
        lo = np.fromiter((np.searchsorted(v, x) for v, x in zip(self.values, at, strict=True)), np.int64, self.m)
        hi, radius = lo.copy(), self.unit
        while True:
            half = self.w * radius / 2
            new_lo = np.fromiter((np.searchsorted(v, x - half, "left") for v, x in zip(self.values, at, strict=True)), np.int64, self.m)
            new_hi = np.fromiter((np.searchsorted(v, x + half, "right") for v, x in zip(self.values, at, strict=True)), np.int64, self.m)
            new_lo, new_hi = np.minimum(new_lo, lo), np.maximum(new_hi, hi)
            rings = [o[a:b] for o, a, b in zip(self.order, new_lo, lo, strict=True)] + [o[a:b] for o, a, b in zip(self.order, hi, new_hi, strict=True)]
            hits += np.bincount(np.concatenate(rings), minlength=n)
            lo, hi = new_lo, new_hi
            found = np.flatnonzero(hits >= self.threshold)
            if len(found) >= enough or len(found) == n or (hi - lo).min() == n:
                break
            radius *= step
        dist = np.sqrt(((self.vecs[found] - q) ** 2).sum(1))
        best = np.lexsort((self.first[found], dist))[: k + 1]
        return [(i, float(d)) for c, d in zip(found[best], dist[best], strict=True) for i in self.ids[c]]


def _searcher(k: int, budget: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        key, vecs, ids, block = None, [], [], None
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True)
            out: list[tuple[int, int, float]] = []
            for b, dim, kind, members, vec in rows:
                if (b, dim) != key:
                    key, vecs, ids, block = (b, dim), [], [], None
                v = vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if kind == 0:
                    vecs.append(v)
                    ids.append(members)
                    continue
                if block is None and vecs:
                    block = Block(np.array(vecs), ids, budget)
                if block is not None:
                    own = members[0]
                    near = sorted((d, i) for i, d in block.search(v, k) if i != own)[:k]
                    out += [(own, i, d) for d, i in near]
            if out:
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, block_rows: int = BLOCK_ROWS, budget: float = BUDGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every query row (``is_query`` over the column vec_id): query_id, rank, vec_id, score."""
    v = valid_vectors(vectors, id_col, vector_col).where(F.col("vec_id").isNotNull())
    smallest = Window.partitionBy("vec").orderBy("vec_id")  # distinct first, so that the limit of the window holds before the shuffle
    classes = v.distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes, "ann-classes")
    blocks = max(1, math.ceil(classes.count() / block_rows))
    dim = F.size("vec")
    base = classes.select(F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int").alias("block"), dim.alias("dim"), F.lit(0).alias("kind"), "ids", "vec")
    queries = v.where(is_query).dropDuplicates(["vec_id", "vec"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dim.alias("dim"), F.lit(1).alias("kind"), F.array("vec_id").alias("ids"), "vec")
    dealt = base.unionByName(queries).repartitionByRange(max(blocks, 1), "block", "dim").sortWithinPartitions("block", "dim", "kind")
    found = dealt.mapInArrow(_searcher(k, budget), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)
