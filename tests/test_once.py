"""What many patterns of a text use is computed once; what can't match isn't compared. Plans are looked at, as rows don't tell."""

from pyspark.sql import functions as F

from cedrela.functions import dictionaries
from cedrela.operators import labels, parsers
from cedrela.plans import whole


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(spark):
    return spark.range(3).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))


def test_a_certificate_is_folded_once_and_its_patterns_wait_for_their_words(spark):
    said = plan(parsers.health(rows(spark)))
    assert said.count("translate(") == 1
    assert said.count("Contains(") > len(parsers.EPS) + len(parsers.ARL) + len(parsers.PENSION) + len(parsers.COMPENSATION)


def test_texts_are_folded_once_for_their_dates(spark, monkeypatch):
    monkeypatch.setattr(whole, "listed", lambda s, d, values: rows(s).select(F.col("doc_id").alias("id"), F.col("text").alias("x")))
    assert plan(whole.text_dates_documents(spark, "")).count("translate(") == 1


def test_places_are_compared_up_to_their_bound(spark):
    said = plan(rows(spark).select(dictionaries.fuzzy_place(F.col("text"))))
    assert "Some(1)" in said and "array_distinct(" in said
    texts = spark.createDataFrame([(1, "x pastoo cali"), (2, "kali pasto kali"), (3, "nada")], "id int, t string")
    got = {r["id"]: r["p"] for r in texts.select("id", dictionaries.fuzzy_place(F.col("t")).alias("p")).collect()}
    assert got == {1: "Cali", 2: "Pasto", 3: None}


def test_terms_of_other_lengths_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(whole, "listed", lambda s, d, values: rows(s).select(F.col("doc_id").alias("id"), F.col("text").alias("x")))
    said = plan(whole.best_match_dictionary_documents(spark, ""))
    assert said.count("lower(") == 1 and said.count("CASE WHEN") >= len(whole.corpus.LEXICON)


def test_labels_are_compared_once_and_lines_folded_once(spark):
    found = spark.createDataFrame([(1, 0, 0, None, "correo", "a@b.co", False)], "doc_id int, pos int, nth int, scope string, label string, value string, alone boolean")
    said = plan(labels.labelled_fields(found, labels.PARTY_LABELS))
    assert said.count("levenshtein(") <= sum(map(len, labels.PARTY_LABELS.values()))
    lines_ = spark.createDataFrame([(1, 0, "Trabajador"), (1, 1, "Fecha de nacimiento")], "doc_id int, pos int, text string")
    assert plan(labels.name_above(labels.in_scopes(lines_), labels.BIRTH_LABELS)).count("explode(array(trim(regexp_replace(translate(") == 1
