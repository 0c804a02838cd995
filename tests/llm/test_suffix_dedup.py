"""Repeated strings against a dictionary of all windows."""

import hashlib
import itertools
import random

import numpy as np

from cedrela.llm import suffix_dedup
from pyspark.sql import functions as F


def brute(rows):
    first, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if (w := raw[i : i + 100]) in first:
                gone[i : i + 100] = True
            first.add(w)
        runs = [k for k, _ in itertools.groupby(gone)]
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), sum(map(bool, runs)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    out = suffix_dedup.repeated_spans(df)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return sorted(tuple(r) for r in out.select("doc_id", "n_bytes", removed, F.size("spans"), "kept_sha256").collect())


def test_cover():
    differences = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert len(differences) == suffix_dedup.PERIOD


def test_copies_of_all_kinds(spark):
    rng = random.Random(11)
    letters = lambda n, s="abcdefgé \n": "".join(rng.choice(s) for _ in range(n))
    shared = [letters(rng.choice([98, 99, 100, 101, 150, 400, 2500])) for _ in range(12)]
    rows = [None, "", "a" * 99, "a" * 100, "a" * 101, "b" * 5000, letters(3000, "ab")]
    for _ in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.5 else letters(rng.randint(0, 200)) for _ in range(rng.randint(1, 5))]
        t = "".join(parts)
        a = rng.randint(0, len(t) // 3)
        rows.append(t[a : len(t) - rng.randint(0, 50)])
    rows += rng.sample(rows, 10)
    rng.shuffle(rows)
    rows = [(5 * i - 100, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("z").alias("TEXT"))
    limits = suffix_dedup.BLOCK, suffix_dedup.BUCKET
    for block, bucket in (limits, (4000, 700)):
        suffix_dedup.BLOCK, suffix_dedup.BUCKET = block, bucket
        try:
            assert got(df.repartition(3)) == brute(rows)
        finally:
            suffix_dedup.BLOCK, suffix_dedup.BUCKET = limits
    assert got(df.where("doc_id > 1000000")) == []


def test_supplied_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])
