"""Nearest neighbours by a block matrix join."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import pick, table

#: Rows of a tile: candidates and queries; and queries of which a task holds the products at once (40 MB).
CANDIDATES, QUERIES, HELD = 4096, 4096, 256


def usable(vector: Column) -> Column:
    """Not null, with no null and no non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 with a scale each, and the length of what rounding left out."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / top  # first by the largest component: no overflow and no underflow in the length
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    small = np.rint(unit / scale).astype(np.int8)
    return small, scale[:, 0], np.sqrt(((unit - small * scale) ** 2).sum(axis=1))


def cosines(query: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Cosine in double precision on the original vectors; sums are taken for each pair by itself, in the same order."""
    dots = (found * query).sum(axis=1)
    return dots / (np.sqrt((query * query).sum()) * np.sqrt((found * found).sum(axis=1)))


def tile(ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of the k best candidates of this tile for each query.

    The product of the int8 matrices is exact (in single precision up to 1,000 dimensions, else double). It is off from the
    true cosine by no more than the two rounding errors allow; candidates whose upper bound reaches the k-th largest lower
    bound survive and are computed again on the original vectors.
    """
    kind = np.float32 if base.shape[1] <= 1000 else np.float64
    small_b, scale_b, off_b = quantised(base)
    turned = small_b.T.astype(kind)
    out = []
    for at in range(0, len(queries), HELD):
        own, own_ids = queries[at : at + HELD], query_ids[at : at + HELD]
        small_q, scale_q, off_q = quantised(own)
        rough = (small_q.astype(kind) @ turned).astype(np.float64) * scale_q[:, None] * scale_b
        off = off_q[:, None] + off_b * (1 + off_q[:, None]) + 1e-9
        rough[own_ids[:, None] == ids] = -np.inf
        low = rough - off
        bar = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -np.inf)
        for i in range(len(own)):
            near = np.flatnonzero((rough[i] + off[i] >= bar[i]) & (rough[i] > -np.inf))
            if len(near):
                score = cosines(own[i], base[near])
                best = heapq.nsmallest(k, zip(-score, ids[near]))
                out += [(own_ids[i], c, -s) for s, c in best]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the largest cosine for each row for which is_query holds.

    Candidates and queries are dealt by hash into blocks of bounded size, and each pair of blocks is one tile (tile()); so
    a set of equal vectors is spread like any other. Each task's heaps leave k rows of a query, the last ranking merges
    them. Nothing is approximated: recall is 1.

    Cases: vectors that are null, zero or hold null or non-finite components take no part, neither as query nor as
    candidate. Rows with the query's own vec_id aren't its candidates. Equal scores go to the smaller vec_id. Vectors meet
    only those of their own dimension. A null vec_id takes no part. Fewer than k candidates: all of them. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    n = rows.agg(F.count("*"), F.sum(F.when(is_query, 1).otherwise(0))).first()
    b, q = math.ceil(n[0] / CANDIDATES) or 1, math.ceil((n[1] or 0) / QUERIES) or 1
    dealt = F.xxhash64("vec_id")
    rows = rows.withColumn("dim", F.size("embedding"))
    base = rows.withColumn("b", F.pmod(dealt, F.lit(b))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    asked = rows.where(is_query).withColumn("q", F.pmod(dealt, F.lit(q))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    cast = [F.col("b").cast("long"), F.col("q").cast("long"), "dim", "vec_id", "embedding"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            flat = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            out = tile(left["vec_id"].to_numpy(), flat(left), right["vec_id"].to_numpy(), flat(right), k)
        parts = list(zip(*out)) or [[], [], []]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    best = (
        base.select(*cast).groupBy("b", "q", "dim").cogroup(asked.select(*cast).groupBy("b", "q", "dim"))
        .applyInArrow(run, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
