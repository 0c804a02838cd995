"""Numbers of links against all pairs in plain Python, in blocks of any size."""

import random

import numpy as np
import pytest

from cedrela.llm import link_counts, ngram_join

from .test_ngram_join import WORD


def plain(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    link = lambda i, j: i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    return sorted((d, len(sets[i]), sum(bool(link(i, j)) for j in range(len(rows)))) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for size, copies in ((60, 40), (25, 12), (200, 8), (7, 5)):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, max(1, size // 60))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t[: len(t) - rng.randint(0, size // 12)]))
            base = t if rng.random() < 0.1 else base
    rows += [rows[3]] * 4 + [rows[20].upper(), None, "", "alone in the whole world here", "A b", "a  b"]
    return list(enumerate(rows))


@pytest.mark.parametrize("rows_of_a_block", [512, 3])
def test_links_against_all_pairs(spark, rows_of_a_block, monkeypatch):
    monkeypatch.setattr(link_counts, "ROWS", rows_of_a_block)
    rows = near_copies(5)
    rows = rows + rows[:2]  # rows that repeat a doc_id are documents, too
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in ngram_join.near_duplicates(df, count_links=True).collect())
    assert got == plain(rows) and max(n for *_, n in got) > 20
    same = sorted(tuple(r)[:3] for r in ngram_join.near_duplicates(df, count_links=True).collect())
    assert same == sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect())


@pytest.mark.parametrize("columns", [4096, 5])
def test_overlaps(columns, monkeypatch):
    monkeypatch.setattr(link_counts, "COLUMNS", columns)
    rng = np.random.default_rng(1)
    some = lambda n: [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(n)]
    a, b = some(13), some(9)
    assert link_counts.overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert link_counts.overlaps([np.zeros(0, np.uint64)], []).shape == (1, 0)


def test_query(spark):
    got = ngram_join.op2_ngram_join(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got.collect()) == plain(docs)
