"""Lines of rows that repeat a doc_id, names that clash, and the registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cedrela.llm import line_dedup

SITES = [(10 + i, f"shared\nline {i}", f"s{i}") for i in range(5)]


@pytest.fixture(scope="module")
def rows(spark):
    return [(5, "x\nshared", "s5"), (5, "INNOCENT\nTWO", "s6"), (5, None, None), (None, "shared\nleft", "s7"), (None, "shared\nleft", "s7"), (30, "", "s1"), (31, "shared\nshared", None), *SITES, SITES[0]]


def test_rows_of_one_doc_id_are_judged_by_themselves(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("z").alias(c) for c in ("_kept", "_changed", "row", "parts", "removed", "TEXT", "c1")]).repartition(3)
    got = line_dedup.clean_documents(df)
    assert got.columns == df.columns
    texts = sorted(((r["doc_id"], r.asDict()["text"], r["source"], r["_kept"]) for r in got.collect()), key=repr)
    gone = lambda i, t, s: t if i is None or t is None else "\n".join(x for x in t.split("\n") if x != "shared")
    assert texts == sorted(((i, gone(i, t, s), s, "z") for i, t, s in rows), key=repr)


def test_long_documents_are_linear(spark):
    many = "\n".join(["boiler"] * 60_000 + ["own"])
    df = spark.createDataFrame([(i, many, f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup.without_boilerplate(df).collect()}
    assert got == {0: "boiler\nown"} | {i: "" for i in range(1, 6)}


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(map(tuple, line_dedup.op5_line_dedup(spark, sf).collect()))
    assert got == sorted(duckdb.sql(line_dedup.OP5_SQL).fetchall())
