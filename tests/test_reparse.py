"""Records of many kinds in one table, and unions that keep the first of what says the same."""

import json

from pyspark.sql import functions as F

from cedrela.operators import reparse
from cedrela.plans import corpus


def test_each_kind_by_its_parser(spark):
    docs = corpus.texts(spark)
    got = {r["doc_id"]: (r["category"], json.loads(r["j"])) for r in reparse.reparsed(docs).select("doc_id", "category", F.to_json("record").alias("j")).collect()}
    assert {c for c, _ in got.values()} >= {"cedula", "salud", "liquidacion", "memorando"}
    for kind, parser in (("cedula", reparse.parsers.id_card), ("memorando", reparse.parsers.memo)):
        own = {i: r for i, (c, r) in got.items() if c == kind}
        for row in parser(docs.where(F.col("doc_id").isin(list(own)))).collect():
            for field, value in row.asDict().items():
                if field != "doc_id":
                    assert own[row["doc_id"]].get(field) == (None if value is None else value if isinstance(value, (int, float, str)) else str(value)), field
    assert reparse.reparsed(docs.limit(0)).collect() == []


def test_the_first_of_equal_records_stays(spark):
    one = spark.createDataFrame([(1, 2, '{"a":1,"b":"x"}'), (1, 1, '{"b":"x","a":1}'), (1, 3, None), (2, 1, '{"a":1,"b":"x"}'), (1, 4, None)], "k int, pos int, j string")
    two = spark.createDataFrame([(1, 0, '{"a":1,"b":"x"}'), (1, 9, '{"a":2}')], "k int, pos int, j string")
    parts = [df.select("k", "pos", F.parse_json("j").alias("record")) for df in (one, two)]
    rows = sorted((r["k"], tuple(r["pos"]), r["j"]) for r in reparse.united(parts, "k").select("k", "pos", F.coalesce(F.to_json("record"), F.lit("-")).alias("j")).collect())
    same = '{"a":1,"b":"x"}'
    assert rows == [(1, (0, 1), same), (1, (0, 3), "-"), (1, (0, 4), "-"), (1, (1, 9), '{"a":2}'), (2, (0, 1), same)]


def test_texts_are_classified_once(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    plan = reparse.reparsed(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("carta de renuncia") == 1
    assert plan.count("translate(") <= 1 + len(set(reparse.PARSERS.values())) + 1  # classification, each parser, lines of functions
