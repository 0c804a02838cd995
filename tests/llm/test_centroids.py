"""Clusters against plain rounds over Python integers, exactness of the parts, and the registered query against its SQL."""

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cedrela.llm import centroids

LONG = 1 << 63


def plain(rows, k, rounds, dim, scale=1024, seed=3):
    """(vec_id, cluster, distance, ...) of every kept vector, by the contract."""
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w))
    own = lambda: [min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        of = own()
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    of = own()
    d = [far(v, c[o]) for (_, v), o in zip(kept, of)]
    fits = lambda values: sum(values) if max(values) < LONG and sum(values) < LONG else None
    each = {j: fits([x for x, o in zip(d, of) if o == j]) for j in set(of)}
    seal = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return [(i, o, x if x < LONG else None, each[o], fits(d), seal[o]) for (i, _), o, x in zip(kept, of, d)]


def vectors(rng, n, dim, sizes):
    middle = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x * rng.choice(sizes) + rng.gauss(0, 0.3) for x in rng.choice(middle)]) for i in range(n)]


CASES = [(0, None), (1, []), (2, [1.0] * 3), (3, [float("nan")] * 4), (4, [None, 1.0, 2.0, 3.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (7, [0.1] * 4), (7, [0.2] * 4), (7, [0.2] * 4)]


@pytest.mark.parametrize("sizes, seed", [([1], 1), ([1, 50], 2), ([1, 1e6], 3), ([1, 1e12], 4), ([1, 1e300], 5), ([1e307], 6), ([0], 7)])
def test_against_plain_rounds(spark, sizes, seed, monkeypatch):
    rows = vectors(random.Random(seed), 300, 4, sizes) + CASES
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("z").alias("block"), F.lit(1).alias("EMBEDDING"), F.lit(2).alias("cluster")).repartition(3)
    monkeypatch.setattr(centroids, "BLOCK", 32)
    got = sorted(map(tuple, centroids.clusters(df, 6, 5, 4).collect()), key=repr)
    assert got == sorted(plain(rows, 6, 5, 4), key=repr)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.clusters(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [-0.75] * 64)]
    assert sorted(map(tuple, centroids.clusters(spark.createDataFrame(rows, schema)).collect())) == sorted(plain(rows, 8, 10, 64))
    assert centroids.clusters(spark.createDataFrame([(None, [0.5] * 64)], schema)).collect() == []
    assert spark.sql("SHOW TABLES").where("tableName LIKE 'blocks_%'").collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_only_what_changed_is_compared(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    top = 3 if seed % 2 else 1 << 40
    v = rng.integers(-top, top, (200, 3)).astype(object if seed % 3 == 0 else np.int64)
    c = rng.integers(-top, top, (6, 3)).tolist()
    owner, far = centroids.reassigned(v, np.full(200, -1), np.zeros(200, np.int64), c, list(range(6)))
    changed = [1, 4]
    for i in changed:
        c[i] = rng.integers(-top, top, 3).tolist()
    compared = []
    real = centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda x, w: (compared.append(len(x)), real(x, w))[1])
    got, d = centroids.reassigned(v, owner, far, c, changed)
    all_far = [[sum((int(a) - b) ** 2 for a, b in zip(x, w)) for w in c] for x in v]
    assert got.tolist() == [min(range(6), key=lambda j: (x[j], j)) for x in all_far]  # noqa: B023
    assert [int(x) for x in d] == [min(x) for x in all_far]
    moved = int(np.isin(owner, changed).sum())
    assert sum(compared) == 2 * (200 - moved) + 6 * moved
    sums = np.zeros((6, 4), object)
    for move in (centroids.transfers(v, np.full(200, -1), owner, 6), centroids.transfers(v, owner, got, 6)):
        for m in move:
            sums[m["cluster"], m["dim"]] += m["value"] << centroids.DIGIT * m["digit"]
    assert sums.tolist() == [[*(sum(int(x[i]) for x, o in zip(v, got) if o == j) for i in range(3)), int((got == j).sum())] for j in range(6)]


def test_packed():
    for values in (np.array([1, -5]), np.array([1 << 40, -1]), np.array([1 << 90, -3], object), np.array([], np.int64)):
        assert centroids.unpacked(centroids.packed(values)).tolist() == values.tolist()


def test_tables_join_without_an_exchange(spark):
    rows = centroids.blocks_of(spark.createDataFrame(vectors(random.Random(1), 50, 4, [1]), "vec_id long, embedding array<double>"), 4, 1024)
    store = centroids.Blocks(spark, 4)
    blocks = store.written(rows.repartition(4, "block"))
    c = [[0, 0, 0, 0], [9, 9, 9, 9]]
    state = store.written(centroids.assigned(blocks, None, c, [0, 1], 4))
    plan = centroids.assigned(blocks, state, c, [1], 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.close()


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = centroids.op12_centroid_clusters(spark, sf)
    want = duckdb.sql(centroids.OP12_SQL)
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
