"""Hits of test items against plain loops over windows, removal of spans, and the registered query against its SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cedrela.llm import decontaminate
from cedrela.llm.decontaminate import Automaton


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window):
    """Words, positions that are hit, items."""
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        k = min(len(own), window)
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return len(words), hit, found - {None}


@pytest.mark.parametrize("seed", range(12))
def test_scan_against_loops(seed):
    rng = random.Random(seed)
    letters = "abcdefghij"[: rng.choice([2, 3, 10])]
    some = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for _ in range(120):
        window = rng.choice([2, 3, 5, 10])
        items = [(rng.choice(["i1", "i2", "i3", "i4", None]), some(rng.choice([4, 12, 40]))) for _ in range(rng.randint(0, 6))]
        held = Automaton([(i, [w.encode() for w in words_of(t)]) for i, t in items if words_of(t)], window)
        for _ in range(6):
            text = some(60) + " " + rng.choice(items or [("", "")])[1] + rng.choice([" ", " x ", "-"]) + some(5)
            n, spans, found = held.scan(text.encode())
            assert (n, {i for a, b in spans for i in range(a, b + 1)}, found) == plain(text, items, window)
            assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_automaton_is_linear_in_its_items():
    rng = random.Random(1)
    words = [str(rng.randint(0, 300)).encode() for _ in range(4000)]
    held = Automaton([("a", words), ("b", words[1000:]), ("c", words[:10])])
    assert len(held.length) <= 2 * 7010 and len(held.go) <= 3 * 7010


ITEMS = [(1, "One two THREE four five six seven eight nine ten, eleven"), (2, "short Item"), (2, "Ünïcode 漢字"), (3, None), (4, "..."), (None, "no id here"), (10, "one two three four five six seven eight nine ten"), (10, "one two three four five six seven eight nine ten")]
TEXTS = [
    (1, "x one two three four five six seven eight nine ten y"), (1, "zero one-two  three four\nfive six seven eight nine ten eleven. End"), (2, "short item; a Short-item"),
    (None, "Ünïcode\t漢字 ünïcode"), (3, None), (4, ""), (5, "no ID here"), (6, "one two three four five six seven eight nine"), (7, "clean text " * 30000 + "short item"), (8, "!?"), (6, "one two three four five six seven eight nine"),
]


@pytest.mark.parametrize("block", [400_000, 5])
def test_rows_and_kept_text(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit("short").alias("TEXT"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("row", "spans", "Doc_ID", "words")]).repartition(3)
    got = decontaminate.contamination(decontaminate.whole(docs), items, ["doc_id", "text"], block_words=block).collect()
    seen = lambda x: (x[0], x[1], x[2], sorted(x[3]), sorted(x[4]))
    rows = [(r["doc_id"], bytes(r["text"]).decode(), r["n_words"], {i for a, b in r["spans"] for i in range(a, b + 1)}, r["items"]) for r in got]
    named = [(None if i is None else str(i), t) for i, t in ITEMS]
    assert sorted(map(seen, rows), key=repr) == sorted((seen((i, t or "", *plain(t, named, 10))) for i, t in TEXTS), key=repr)
    assert all(list(r["items"]) == sorted(r["items"]) for r in got)

    out = decontaminate.decontaminated(docs, items, min_words=2, max_coverage=0.95, block_words=block)
    kept = {(r["doc_id"], r["n_words"]): (r["removed"], r["kept_text"]) for r in out.collect()}
    assert kept[1, 12] == (False, "x  y") and kept[1, 13] == (False, "zero . End")
    assert kept[2, 5] == (False, "; a ") and kept[5, 3] == (True, "") and kept[6, 9] == (False, TEXTS[7][1])
    assert kept[None, 3] == (False, " ünïcode")
    assert kept[3, 0] == (False, "") and kept[8, 0] == (False, "!?")


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(50)]
    items = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    texts = [(i, " ".join(words[i : i + 10])) for i in range(41)]
    got = decontaminate.contamination(decontaminate.whole(spark.createDataFrame(texts, "doc_id long, text string")), items, ["doc_id"], block_words=20).collect()
    assert sorted((r["doc_id"], decontaminate_hits(r)) for r in got) == [(i, 10) for i in range(41)]
    assert {tuple(r["items"]) for r in got} == {("long",)}


def decontaminate_hits(row):
    return sum(b - a + 1 for a, b in row["spans"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminated(docs, none).collect()] == [(1, 2, 0, [], False, "a b")]
    assert decontaminate.decontaminated(docs.limit(0), none).collect() == []


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = decontaminate.op13_decontamination(spark, sf)
    got = sorted(map(tuple, df.collect()))
    want = duckdb.sql(decontaminate.OP13_SQL)
    assert df.columns == want.columns and got == sorted(want.fetchall()) and any(r[5] for r in got)
