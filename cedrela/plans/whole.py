"""The operators that elsewhere run over invented texts only, over whole tables with those texts as further rows.

The invented rows have negative numbers. The SQL is that of the query on invented texts, with the rows in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import classify, dates, dictionaries, names, numbers, repair, text
from ..operators import grouping, lines, parsers
from ..operators import people as people_operators
from . import Catalogue, corpus, documents, people, structure

C = Catalogue()

ALL_TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {corpus.TEXTS_SQL}) v"


def texts(spark: SparkSession, d: str, invented: DataFrame | None = None) -> DataFrame:
    """doc_id, text of all documents and of the invented texts."""
    mine = corpus.texts(spark) if invented is None else invented
    return views.read(spark, d, "documents").select("doc_id", "text").union(mine.select((-F.col("doc_id")).cast("long"), "text"))


def listed(spark: SparkSession, d: str, values: list[str | None]) -> DataFrame:
    """id, x of all documents and of a list of invented texts."""
    mine = corpus.listed(spark, values).select((-1 - F.col("id")).cast("long"), "x")
    return views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x")).union(mine)


def texts_sql(part: Catalogue, name: str) -> str:
    return part.sql[name].replace(corpus.TEXTS_SQL, ALL_TEXTS)


def listed_sql(part: Catalogue, name: str, values: list[str | None]) -> str:
    mine = corpus.listed_sql(values)
    return part.sql[name].replace(mine, f"(SELECT doc_id AS id, text AS x FROM documents UNION ALL SELECT -1 - id, x FROM {mine}) v")


@C.add(listed_sql(documents.C, "best_match_dictionary", corpus.WORDS))
def best_match_dictionary_documents(spark: SparkSession, d: str) -> DataFrame:
    m = text.best_match(F.col("lower"), [t.lower() for t in corpus.LEXICON])
    return text.held(listed(spark, d, corpus.WORDS), lower=F.lower("x")).select("id", m["term"].alias("term"), m["score"].alias("score"))


@C.add(listed_sql(documents.C, "text_dates", corpus.DATES))
def text_dates_documents(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("folded")
    span = F.col("span")
    return text.held(listed(spark, d, corpus.DATES), folded=text.fold_only(F.col("x")), span=dates.date_range(F.col("folded"))).select(
        "id", dates.normal_date(f).alias("form_a"), dates.loose_date(f).alias("form_b"), dates.first_date(f).alias("first_in_text"), span["start"].alias("range_start"), span["end"].alias("range_end")
    )


@C.add(listed_sql(documents.C, "text_amounts", corpus.AMOUNTS))
def text_amounts_documents(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return listed(spark, d, corpus.AMOUNTS).select("id", numbers.amount(x).alias("amount"), numbers.salary(text.fold_only(x)).alias("salary"), numbers.expected_salary(x).alias("expected"))


@C.add(listed_sql(documents.C, "name_split", corpus.NAMES))
def name_split_documents(spark: SparkSession, d: str) -> DataFrame:
    a, b = names.split_name(F.col("x")), names.split_name_plain(F.col("x"))
    return listed(spark, d, corpus.NAMES).select("id", a["first_names"].alias("first_a"), a["last_names"].alias("last_a"), b["first_names"].alias("first_b"), b["last_names"].alias("last_b"))


@C.add(texts_sql(documents.C, "document_form"))
def document_form_documents(spark: SparkSession, d: str) -> DataFrame:
    return classify.classified(texts(spark, d)).groupBy(classify.form(F.col("category")).alias("form")).agg(F.count("*").alias("n"))


@C.add(texts_sql(documents.C, "parse_id_card"))
def parse_id_card_documents(spark: SparkSession, d: str) -> DataFrame:
    return parsers.id_card(texts(spark, d))


@C.add(texts_sql(documents.C, "parse_health"))
def parse_health_documents(spark: SparkSession, d: str) -> DataFrame:
    return parsers.health(texts(spark, d))


@C.add(texts_sql(documents.C, "parse_settlement"))
def parse_settlement_documents(spark: SparkSession, d: str) -> DataFrame:
    return parsers.settlement(texts(spark, d))


@C.add(texts_sql(documents.C, "parse_memo"))
def parse_memo_documents(spark: SparkSession, d: str) -> DataFrame:
    return parsers.memo(texts(spark, d))


@C.add(texts_sql(documents.C, "parse_functions"))
def parse_functions_documents(spark: SparkSession, d: str) -> DataFrame:
    return parsers.job_functions(texts(spark, d)).withColumn("functions", F.array_join("functions", "|"))


@C.add(texts_sql(documents.C, "term_bounds"))
def term_bounds_documents(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", dates.term_months(text.fold_only(F.col("text"))).alias("months"))


@C.add(texts_sql(structure.C, "label_lookup"))
def label_lookup_documents(spark: SparkSession, d: str) -> DataFrame:
    return lines.label_value(lines.of_text(texts(spark, d)), structure.LABELS)


@C.add(listed_sql(structure.C, "job_family", structure.TITLES))
def job_family_documents(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d, structure.TITLES).select("id", dictionaries.job_family(F.col("x")).alias("family"))


@C.add(listed_sql(structure.C, "place_lookup", structure.SPOTS))
def place_lookup_documents(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return listed(spark, d, structure.SPOTS).select("id", dictionaries.find_place(x).alias("place"), dictionaries.fuzzy_place(x).alias("fuzzy"))


@C.add(listed_sql(structure.C, "skills_tagging", structure.KNOW))
def skills_tagging_documents(spark: SparkSession, d: str) -> DataFrame:
    found = listed(spark, d, structure.KNOW).select("id", F.explode(dictionaries.skills(F.col("x"))).alias("s"))
    return found.select("id", "s.*")


PEOPLE_SQL = corpus.sql_values(structure.PEOPLE, "doc_id, pos, name, document_number")
ALL_PEOPLE = f"(SELECT id AS doc_id, id AS pos, worker_name AS name, worker_document_number AS document_number FROM employee_documents UNION ALL SELECT -doc_id, -pos, name, document_number FROM {PEOPLE_SQL}) v"


@C.add(structure.C.sql["entity_groups"].replace("WITH d AS", f"WITH {views.SQL['employee_documents']}, d AS", 1).replace(f"FROM {PEOPLE_SQL}", f"FROM {ALL_PEOPLE}", 1))
def entity_groups_documents(spark: SparkSession, d: str) -> DataFrame:
    given = views.employee_documents(spark, d).select(F.col("id").alias("doc_id"), F.col("id").alias("pos"), F.col("worker_name").alias("name"), F.col("worker_document_number").alias("document_number"))
    mine = spark.createDataFrame(structure.PEOPLE, "doc_id int, pos int, name string, document_number string")
    return grouping.entity_groups(given.union(mine.select((-F.col("doc_id")).cast("long"), (-F.col("pos")).cast("long"), "name", "document_number")))


@C.add()
def parse_contract_documents(spark: SparkSession, d: str) -> DataFrame:
    return people_operators.contract_records(texts(spark, d, spark.createDataFrame(list(people.CONTRACTS.items()), "doc_id int, text string")))


@C.add()
def email_repair_documents(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d, people.EMAILS).select("id", repair.email_in(F.col("x")).alias("email"))


@C.add()
def segment_words_documents(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d, people.GLUED).select("id", repair.segmented(F.col("x")).alias("s")).select("id", "s.*")
