"""Dictionaries as tables against all pairs of text and term."""

import random

import pytest
from pyspark.sql import functions as F

from cedrela.functions import dictionaries
from cedrela.operators import dictionary
from cedrela.operators.dictionary import Automaton


def alone(text, at):
    return not 0 <= at < len(text) or not (text[at].isascii() and text[at].isalnum())


def plain(text, terms, words):
    out = []
    for number, term in enumerate(terms):
        for at in range(len(text) - len(term) + 1):
            if term and text.startswith(term, at) and (not words or alone(text, at - 1) and alone(text, at + len(term))):
                out.append((number, at))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_automaton_against_all_pairs(seed):
    rng = random.Random(seed)
    letters = ["ab", "abc +", "añ\U0001f600 .", "a"][seed % 4]
    for _ in range(150):
        terms = list({"".join(rng.choice(letters) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 12))})
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        for words in (False, True):
            assert sorted(Automaton(terms).found(text, words)) == plain(text, terms, words)


def test_many_terms_in_blocks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    terms = sorted({f"{word()} {word()}" if i % 3 else word() for i in range(10_000)})
    texts = [(i, " ".join(rng.choice(terms) for _ in range(12))) for i in range(60)] + [(99, None), (98, ""), (1, terms[0])]
    df, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in [*terms, terms[5], None, ""]], "term string")
    padded = [(i, f" {t} ") for i, t in texts if t]
    want = sorted((i, term, t.count(f" {term} "), t.index(f" {term} ")) for i, t in padded for term in terms if f" {term} " in t)
    fine = lambda rows: sorted((r["id"], r["term"], r["first"]) for r in rows)
    whole = dictionary.occurrences(df, table).collect()
    assert fine(whole) == [(i, t, f) for i, t, _, f in want]
    assert fine(dictionary.occurrences(df, table, block=20_000).collect()) == fine(whole)


def test_places_skills_and_families_as_the_short_lists_have_them(spark):
    texts = ["Vivo en Santa Marta, cerca de Cali", "villa del rosario norte de santander", "Medellin", None, "nada", "Norte de Santander y Cúcuta", "PASTO-cali", "Javascript, SQL y java; power point", "javanes sqlite", "C++ y excel"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    places = spark.createDataFrame([(p,) for p in dictionaries.PLACES], "place string")
    want = {r["id"]: r["x"] for r in df.select("id", dictionaries.find_place(F.col("text")).alias("x")).collect() if r["x"]}
    assert {r["id"]: r["place"] for r in dictionary.first_place(df, places).collect()} == want and len(want) == 5
    rows = [(i, c, s) for i, (c, s) in enumerate((c, s) for c, ss in dictionaries.SKILLS.items() for s in ss)]
    got = {r["id"]: r["skills"] for r in dictionary.tagged(df, spark.createDataFrame(rows, "nth int, category string, skill string")).collect()}
    assert got == {r["id"]: r["x"] for r in df.select("id", dictionaries.skills(F.col("text")).alias("x")).collect() if r["x"]} and len(got) == 2
    titles = ["Aseador", "Auxiliar de nómina senior", "jefe de personal y talento humano", "OPERARIO", "cooperarios", None, "nada"]
    jobs = spark.createDataFrame(list(enumerate(titles)), "id long, text string")
    terms = spark.createDataFrame([(t, f) for f, ts in dictionaries.FAMILIES.items() for t in ts], "term string, family string")
    got = {r["id"]: r["family"] for r in dictionary.families(jobs, terms).collect()}
    assert got == {r["id"]: r["x"] for r in jobs.select("id", dictionaries.job_family(F.col("text")).alias("x")).collect() if r["x"]} and len(got) == 5


def test_words_that_few_texts_have(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "a a d-e"), (4, ""), (5, None)], "id long, text string")
    got = sorted((r["id"], r["word"], r["docs"]) for r in dictionary.rarest_words(df, 2).collect())
    assert got == [(1, "b", 2), (1, "c", 1), (2, "a", 3), (2, "b", 2), (3, "d", 1), (3, "e", 1)]


def test_what_is_found_is_never_broadcast(spark):
    found = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id long, term string")
    terms = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "term string, weight int")
    rows = {(r["id"], r["weight"]) for r in dictionary.with_terms(found, terms, "term").collect()}
    assert rows == {(i, w) for i in range(40) for w in ((1,) if i % 2 == 0 else (2, 3))}
    few = spark.range(20).selectExpr("id", "CAST(id AS STRING) AS skills", "'' AS headline", "'' AS education", "'' AS city")
    asked = spark.createDataFrame([(1, "1", 2, "habilidad")], "vacancy_id int, skill_or_req string, weight int, req_type string")
    from cedrela.operators import matching

    plan = matching.best_matches(few, asked)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.split("\n") if "BroadcastHashJoin [kind" in line]
    assert joins and all("BuildRight" in line for line in joins)
