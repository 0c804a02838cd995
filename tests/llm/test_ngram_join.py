"""Near duplicates against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from cedrela.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            if root(i) != root(j) and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect())


def test_groups_and_edges(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], text(60)
    for g in range(12):
        base = text(rng.choice([3, 5, 8, 20, 80, 200]))
        for _ in range(rng.choice([1, 2, 15])):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = rng.choice(words).upper()
            rows.append(" ".join(t))
            base = t if g % 3 == 0 else base  # chains
    rows += [" ".join(text(rng.randint(0, 40)) + passage + text(rng.randint(0, 40))) for _ in range(60)]
    rows += [None, "", " \n", "A b", "a  b", "b a", "x", "x", "y " * 3000]
    rows = [(3 * i, t) for i, t in enumerate(rows)]
    rng.shuffle(rows)
    assert got(spark, rows + rows[:2]) == brute(rows + rows[:2])


def test_supplied_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute(rows)


def test_nothing(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, None)], "doc_id long, text string")
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == {(None, 2, None), (4, 0, 4)}


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e", "A b C d E f"])
def test_shingles(text):
    w = text.lower().split()
    assert len(ngram_join.shingles([text])[0]) == (max(len(w) - 4, 1) if w else 0)


@pytest.mark.parametrize("sizes", [(1, 1, 0), (40, 44, 30), (300, 310, 290), (700, 500, 500), (3000, 3900, 2800), (5, 0, 0)])
def test_parities_are_a_bound(sizes):
    a, b, shared = sizes
    x = np.random.default_rng(a).integers(0, 1 << 63, a + b - shared, np.int64).astype(np.uint64)
    one, other = x[:a], x[a - shared :]
    bound = ngram_join.apart_at_least(ngram_join.parities(one), ngram_join.parities(other))
    assert bound <= a + b - 2 * shared
