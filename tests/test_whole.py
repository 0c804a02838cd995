"""Every operator on invented texts also reads whole tables: a document with an invented text gives what that text gives."""

import pytest

import __spark_entry__ as entry
from cedrela.plans import corpus, people, structure

TEXTS = {
    **dict.fromkeys(["parse_id_card", "parse_health", "parse_settlement", "parse_memo", "parse_functions", "term_bounds", "label_lookup"], corpus.TEXTS),
    "parse_contract": people.CONTRACTS,
}
LISTED = {
    "best_match_dictionary": corpus.WORDS, "text_dates": corpus.DATES, "text_amounts": corpus.AMOUNTS, "name_split": corpus.NAMES, "job_family": structure.TITLES,
    "place_lookup": structure.SPOTS, "skills_tagging": structure.KNOW, "email_repair": people.EMAILS, "segment_words": people.GLUED,
}
#: With those over the texts alone, which aren't registered.
QUERIES = entry.queries() | {name: part.C.queries[name] for part in entry.PARTS for name in part.C.aside}


def documents(spark, tmp_path, rows):
    rows = [(i, x, "es", "a.org", len(x or "")) for i, x in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [*TEXTS, *LISTED])
def test_documents_are_read(spark, tmp_path, name):
    same = {1000 + k: -k for k in TEXTS[name]} if name in TEXTS else {1000 + k: -1 - k for k in range(len(LISTED[name]))}
    values = TEXTS[name].items() if name in TEXTS else enumerate(LISTED[name])
    sf = documents(spark, tmp_path, [(1000 + k, x) for k, x in values])
    rows = [tuple(r) for r in QUERIES[f"{name}_documents"](spark, sf).collect()]
    given, mine = sorted(repr((same[r[0]], *r[1:])) for r in rows if r[0] >= 0), sorted(repr(r) for r in rows if r[0] < 0)
    assert given and given == mine


def test_forms(spark, tmp_path):
    sf = documents(spark, tmp_path, [(k, x) for k, x in corpus.TEXTS.items()])
    alone = {r["form"]: r["n"] for r in QUERIES["document_form"](spark, sf).collect()}
    assert {r["form"]: r["n"] for r in QUERIES["document_form_documents"](spark, sf).collect()} == {k: 2 * n for k, n in alone.items()}


def test_groups(spark, tmp_path):
    sf = documents(spark, tmp_path, [(k, "x") for k in range(30)])
    assert {r["doc_id"] for r in QUERIES["entity_groups_documents"](spark, sf).collect()} == {*range(30), *(-r[0] for r in structure.PEOPLE)}
