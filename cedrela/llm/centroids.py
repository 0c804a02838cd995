"""Centroid clustering by Lloyd's rounds that work on what changed."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_dir, small_batches, stage, table

DIM, K, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors of a block; blocks of a bucket (a task's share) at most.
BLOCK, BLOCKS = 2048, 256
#: Below this, squared distances of up to 128 components fit 64 bits; beyond, Python's integers are used.
NARROW = 1 << 27
#: Large sums are told in digits of so many bits.
DIGIT = 60
MOVE = "array<struct<cluster:int,dim:int,digit:int,value:long>>"
MOVE_TYPE = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))


def packed(values: np.ndarray) -> bytes:
    """Integers as bytes: of 32 or 64 bits where they fit, else in decimal."""
    if values.dtype != object:
        small = values.size == 0 or max(-int(values.min()), int(values.max())) < 1 << 31
        return (b"i" + values.astype("<i4").tobytes()) if small else b"l" + values.astype("<i8").tobytes()
    return b"d" + ",".join(map(str, values.ravel())).encode()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"d":
        return np.array([int(x) for x in data[1:].split(b",")] if len(data) > 1 else [], object)
    return np.frombuffer(data, "<i4" if data[:1] == b"i" else "<i8", offset=1).astype(np.int64)


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; Python integers if any has 27 bits or more."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    if not vectors.size or np.abs(scaled).max() < NARROW:
        return scaled.astype(np.int64)
    return np.array([[int(y) if math.isfinite(y) else int(x) * scale for x, y in zip(*row)] for row in zip(vectors.tolist(), scaled.tolist())], object)


def distances(vectors: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Squared Euclidean distances, exactly."""
    wide = vectors.dtype == object or max(map(abs, centroid), default=0) >= NARROW
    off = (vectors.astype(object) if wide else vectors) - np.array(centroid, object if wide else np.int64)
    return (off * off).sum(axis=1) if wide else np.einsum("ij,ij->i", off, off)


def nearer(vectors: np.ndarray, centroids: list[list[int]], which: list[int], owner: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """owner and distance after comparison with the centroids `which`; owner -1: none so far. Ties: the smaller number."""
    for c in which:
        d = distances(vectors, centroids[c])
        if d.dtype == object:
            far = far.astype(object)
        better = (owner < 0) | (d < far) | ((d == far) & (c < owner))
        owner, far = np.where(better, c, owner), np.where(better, d, far)
    return owner, far


def reassigned(vectors: np.ndarray, owner: np.ndarray, far: np.ndarray, centroids: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The assignment after the centroids `changed` changed.

    A vector whose own centroid stayed is compared with the changed ones only: the others were no nearer before and are as
    far as they were. One whose own centroid moved is compared with all.
    """
    stay = ~np.isin(owner, [-1, *changed])
    owner, far = owner.copy(), far.copy()
    out = []
    for rows, which in ((stay, changed), (~stay, range(len(centroids)))):
        at = np.flatnonzero(rows)
        start = owner[at] if which is changed else np.full(len(at), -1)
        out.append((at, *nearer(vectors[at], centroids, list(which), start, far[at])))
    far = far.astype(object) if any(f.dtype == object for _, _, f in out) else far
    for at, new, f in out:
        owner[at], far[at] = new, f
    if far.dtype == object and (not len(far) or max(far) < 1 << 63):
        far = far.astype(np.int64)
    return owner, far


def digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, at = (1 if value >= 0 else -1), abs(value), 0
    while value:
        yield at, sign * (value & ((1 << DIGIT) - 1))
        value >>= DIGIT
        at += 1


def transfers(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[dict]:
    """What the sums (dim from 0) and the count (dim after the last) of each centroid gain or lose by vectors that moved."""
    moved = np.flatnonzero(before != after)
    out = []
    for c in range(k) if len(moved) else ():
        come, go = vectors[moved[after[moved] == c]], vectors[moved[before[moved] == c]]
        if len(come) or len(go):
            total = [*(come.sum(axis=0) - go.sum(axis=0)), len(come) - len(go)]
            out += [{"cluster": c, "dim": i, "digit": d, "value": x} for i, v in enumerate(total) for d, x in digits(int(v))]
    return out


class Blocks:
    """Blocks of vectors and, round by round, their assignments, as tables with the same buckets in the shared folder.

    Joining the two needs no exchange, and only the assignments (some 8 bytes a vector) are written in a round. Files stay
    until the cluster clears the folder, the tables' names go with close().
    """

    def __init__(self, spark: SparkSession, n_buckets: int):
        self.spark, self.n_buckets, self.names = spark, n_buckets, []

    def written(self, df: DataFrame) -> DataFrame:
        name = f"blocks_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.bucketBy(self.n_buckets, "block").sortBy("block").option("path", f"{shared_dir(self.spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def blocks_of(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """block, ids, vectors (packed) of rows (vec_id, embedding), BLOCK rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ids = pa.array([part.column("vec_id").to_pylist()], pa.list_(part.column("vec_id").type))
                yield pa.record_batch([part.column("block").slice(0, 1), ids, pa.array([packed(integers(flat, scale))])], ["block", "ids", "vectors"])

    kind = dict(rows.dtypes)["vec_id"]
    rows = rows.withColumn("block", F.monotonically_increasing_id())  # a block is named by its first row
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, vectors binary")


def assigned(blocks: DataFrame, state: DataFrame | None, centroids: list[list[int]], changed: list[int], dim: int) -> DataFrame:
    """block, owner, far (packed), moved: the assignments after the centroids `changed` changed, and the transfers."""
    fresh = state is None
    joined = blocks.select("block", "vectors") if fresh else blocks.select("block", "vectors").join(state.select("block", "owner", "far").hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                vectors = unpacked(cell("vectors")).reshape(-1, dim)
                before = np.full(len(vectors), -1) if fresh else unpacked(cell("owner"))
                far = np.zeros(len(vectors), np.int64) if fresh else unpacked(cell("far"))
                owner, far = reassigned(vectors, before, far, centroids, changed)
                columns = [batch.column("block").slice(i, 1), pa.array([packed(owner)]), pa.array([packed(far)]), pa.array([transfers(vectors, before, owner, len(centroids))], MOVE_TYPE)]
                yield pa.record_batch(columns, ["block", "owner", "far", "moved"])

    return joined.mapInArrow(run, f"block long, owner binary, far binary, moved {MOVE}")


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Lloyd's rounds in integers. Assignments, with the distance to the own centroid, are kept from round to round, and so are
    the sums of all clusters. A round compares vectors whose own centroid moved with all centroids and the others with the
    changed centroids only; what moved from one cluster to another goes into the sums as signed transfers, added up by block
    and then by Spark (k * 65 numbers reach the driver). Rounds end early where no centroid changes.

    Cases: vectors that are null, of another length, or hold null or non-finite components are left out. Components of any
    size are computed exactly; a distance or inertia beyond a long is null. Rows that repeat a vec_id are vectors of their
    own; a null vec_id is assigned like any other but is no start. Equal starts stay as they are (the smaller number owns).
    Fewer than k vectors with a vec_id: as many centroids. Without a start there are no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = pick(vectors, "vec_id", "embedding").where((F.size("embedding") == dim) & fine)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id IS NOT NULL").orderBy(order, "embedding").limit(k).collect()
    centroids = [[int(x) for x in integers(np.array([r["embedding"]], np.float64), scale)[0]] for r in first]
    if not centroids:
        kind = dict(rows.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    n_blocks = math.ceil(rows.count() / BLOCK)
    store = Blocks(spark, max(1, math.ceil(n_blocks / BLOCKS), min(n_blocks, spark.sparkContext.defaultParallelism)))
    try:
        blocks = store.written(blocks_of(rows, dim, scale).repartition(store.n_buckets, "block"))
        state, changed = None, list(range(len(centroids)))
        sums = [[0] * (dim + 1) for _ in centroids]
        for number in range(rounds + 1):
            state = store.written(assigned(blocks, state, centroids, changed, dim))
            if number == rounds:
                break
            moved = state.select(F.explode("moved").alias("m")).groupBy("m.cluster", "m.dim", "m.digit")
            for cluster, at, digit, value in moved.agg(F.sum(F.col("m.value").cast("decimal(38,0)"))).collect():
                sums[cluster][at] += int(value) << DIGIT * digit
            new = [[x // s[dim] for x in s[:dim]] if s[dim] else c for s, c in zip(sums, centroids)]
            changed = [i for i, (x, y) in enumerate(zip(new, centroids)) if x != y]
            centroids = new
            if not changed:
                break
        return described(blocks, state, centroids)
    finally:
        store.close()


def described(blocks: DataFrame, state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows of the result, one for each vector."""
    spark = blocks.sparkSession
    id_kind = dict(blocks.dtypes)["ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                far = unpacked(batch.column("far")[i].as_py())
                far = pa.array([int(x) if x < 1 << 63 else None for x in far] if far.dtype == object else far, pa.int64())
                yield pa.record_batch([batch.column("ids")[i].values, pa.array(unpacked(batch.column("owner")[i].as_py()), pa.int32()), far], ["vec_id", "cluster", "distance"])

    found = stage(blocks.select("block", "ids").join(state.select("block", "owner", "far").hint("merge"), "block").mapInArrow(run, f"vec_id {id_kind}, cluster int, distance long"))
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = {r[0]: r[1] for r in found.groupBy("cluster").agg(total).collect()}
    fits = lambda x: None if x is None or x >= 1 << 63 else int(x)
    everything = fits(None if None in each.values() else sum(each.values()))
    seal = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = [(i, fits(each[i]), everything, seal[i]) for i in sorted(each)]  # a row for each centroid
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    """Each round as two tables: assignments to the centroids before it, and the centroids after it."""
    parts = []
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT row, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT row, v, c, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, w)])::BIGINT AS d FROM kept, c{i}
  ) GROUP BY row, v
)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (
  SELECT c, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j
), c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.w, o.w) AS w FROM c{i} o
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS w FROM s{i} GROUP BY c) n USING (c)
)""")
    return ", ".join(parts)


#: Every round compares every vector with every centroid here.
OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIM}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS w FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {K})
), {_rounds_sql()}, last AS (
  SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia
  FROM a{ROUNDS} a JOIN kept k USING (row)
)
SELECT l.*, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM last l JOIN c{ROUNDS} ON c = cluster
"""
