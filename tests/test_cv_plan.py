"""The CV parser goes through lines and texts once."""

from cedrela.operators import cv, people


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_laid_out_once_for_sections_and_once_for_labels(spark):
    """Before, each section and each label laid them out anew: 13 times."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert plan(people.cv_records(docs)).count("posexplode(split") <= 2


def test_texts_are_folded_once(spark):
    """Before, 23 times in the plan."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert plan(people.cv_records(docs).select("doc_id", "email", "phone", "document_number", "skills")).count("translate(") == 1


def test_the_record_is_computed_once_beside_its_headline(spark):
    docs = spark.createDataFrame([(1, "ANA PRUEBA DIAZ\nAuxiliar contable"), (2, None)], "doc_id long, text string")
    out = cv.cvs(docs)
    assert plan(out).count("posexplode(split") <= 2
    assert sorted((r["doc_id"], r["headline"]) for r in out.collect()) == [(1, "Auxiliar contable"), (2, None)]
