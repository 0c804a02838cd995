"""Differences between sources against plain loops, the sketch's promise, and the registered query against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cedrela.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    """The contract, term by term."""
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, n, groups = Counter(), Counter(), defaultdict(Counter)
        for la, so, words in docs:
            if la == lang:
                seen.update(set(words))
                n.update(words)
                groups[so].update(words)
        kept = [t for t, c in seen.items() if c >= min_docs]
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, ps = p(n), {g: p(c) for g, c in groups.items()}
        for g in groups:
            parts = {
                "pair": [(sum(abs(ps[g][t] - ps[o][t]) for t in kept), o) for o in groups if o != g],
                "term": [(ps[g][t] - q[t], t) for t in kept if groups[g][t] and ps[g][t] > q[t]],
            }
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g, part, item, value, i) for i, (value, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["The", "the", "été", "Ünder", "a1b", "x_y", "ñ", "漢字", "İstanbul", "z" * 300] + [f"w{chr(97 + i)}" for i in range(12)]
    made = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "s1", "s2", None, "", "\U0001f600"])
        made.append((i % 100, " \n\x00-".join(rng.choices(words, k=rng.randint(0, 25))), lang, source))
    made += [(1, None, "en", "s9"), (None, "", "xx", "one"), (None, "rare words", "yy", "one"), (3, "12 34 --", "yy", "two")]
    return made + made[:5]


def test_against_loops(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("z").alias("TEXT"), F.lit(1).alias("n"), F.lit("t").alias("term")).repartition(5)
    for min_docs, width in ((30, 1 << 16), (8, 1 << 16), (400, 1 << 20)):
        got = divergence.divergence(df, min_docs, 3, width)
        assert sorted(map(tuple, got.collect())) == plain(rows, min_docs, 3)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_a_full_sketch_lets_everything_through_and_an_ample_one_little(spark, rows, monkeypatch):
    texts = [(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} common", "en", "s") for i in range(2000)]
    docs = spark.createDataFrame(texts, "text string, lang string, source string").withColumn("text", F.col("text").cast("binary"))
    monkeypatch.setattr(divergence, "CHUNK", 16)
    kept = {r["term"]: (r["n"], r["docs"]) for r in divergence.term_counts(docs, 30, 16).collect()}
    assert kept["common"] == (2000, 2000) and len(kept) == 2001
    monkeypatch.setattr(divergence, "CHUNK", 1 << 16)
    assert [tuple(r) for r in divergence.term_counts(docs, 30, 1 << 20).collect()] == [("en", "s", "common", 2000, 2000)]


def test_terms_are_passed_on_in_parts(spark, rows, monkeypatch):
    batch = pa.record_batch({"text": [b"a b a", b"b c", b"c"], "lang": ["x", "x", "y"]})
    monkeypatch.setattr(divergence, "HELD", 1)
    parts = list(divergence.counted([batch], ["lang"], True))
    assert len(parts) == 3
    total = sum((Counter({(g, t): k for g, c in n.items() for t, k in c.items()}) for n, _ in parts), Counter())
    assert total == {(("x",), b"a"): 2, (("x",), b"b"): 2, (("x",), b"c"): 1, (("y",), b"c"): 1}


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    got = divergence.divergence(spark.createDataFrame([(1, None, None, "b"), (2, "x", None, "a")], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_counts_beyond_longs(spark):
    n, total, kept = 9_000_000_000_000, 9_100_000_000_001, 77
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, divergence.op11_source_divergence(spark, sf).collect()))
    assert got == sorted(duckdb.sql(divergence.OP11_SQL).fetchall())
