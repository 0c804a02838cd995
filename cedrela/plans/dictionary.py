"""Dictionaries as tables over all documents and parts, against all pairs of text and term in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.text import fold
from ..operators import dictionary
from . import Catalogue
from .fields import FOLD

C = Catalogue()

#: The folded text between blanks, with everything but letters and digits as one blank.
SPACED = f"' ' || trim(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g')) || ' '"
#: Terms: all words of the test items of four letters or more.
TERMS = f"""term AS (SELECT DISTINCT unnest(string_split_regex({FOLD.format('text')}, '[^a-z0-9]+')) AS term FROM benchmark)"""


def benchmark_words(spark: SparkSession, d: str) -> DataFrame:
    words = views.read(spark, d, "benchmark").select(F.explode(F.split(fold(F.col("text")), "[^a-z0-9]+")).alias("term"))
    return words.where(F.length("term") >= 4).distinct()


@C.add(
    f"""WITH {TERMS}, t AS (SELECT doc_id, {SPACED.format('text')} AS x FROM documents), w AS (SELECT doc_id, unnest(string_split(trim(x), ' ')) AS term FROM t)
SELECT doc_id, term, count(*) AS n FROM w SEMI JOIN (SELECT term FROM term WHERE length(term) >= 4) k USING (term) GROUP BY doc_id, term"""
)
def term_occurrences_documents(spark: SparkSession, d: str) -> DataFrame:
    texts = views.read(spark, d, "documents").select(F.col("doc_id").alias("id"), fold(F.col("text")).alias("text"))
    return dictionary.occurrences(texts, benchmark_words(spark, d)).select(F.col("id").alias("doc_id"), "term", "n")


#: A part's name, type, size and brand as a text, and terms out of them.
PART_TEXT = "p_name || ' / ' || p_type || ', (' || p_size || ') ' || p_brand"
SKILL_ROWS = """skill AS (SELECT row_number() OVER (ORDER BY category, skill) AS nth, category, skill FROM (
  SELECT DISTINCT 'name' AS category, unnest(string_split(p_name, ' ')) AS skill FROM part UNION SELECT DISTINCT 'type', p_type FROM part UNION SELECT DISTINCT 'size', '(' || p_size || ')' FROM part
  UNION SELECT DISTINCT 'pair', p_brand || ' ' || p_name FROM part UNION SELECT DISTINCT 'supplier', s_name FROM supplier))"""


def part_texts(spark: SparkSession, d: str) -> DataFrame:
    part = views.read(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" / "), "p_type", F.lit(", ("), "p_size", F.lit(") "), "p_brand").alias("text"))


def part_skills(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy of thousands of terms: nth, category, skill."""
    part, supplier = views.read(spark, d, "part"), views.read(spark, d, "supplier")
    row = lambda category, skill, of=part: of.select(F.lit(category).alias("category"), skill.alias("skill"))
    rows = row("name", F.explode(F.split("p_name", " "))).union(row("type", F.col("p_type"))).union(row("size", F.concat(F.lit("("), "p_size", F.lit(")"))))
    rows = rows.union(row("pair", F.concat_ws(" ", "p_brand", "p_name"))).union(row("supplier", F.col("s_name"), supplier)).distinct()
    return rows.withColumn("nth", F.struct("category", "skill"))


@C.add(
    f"""WITH {SKILL_ROWS}, t AS (SELECT p_partkey AS id, {FOLD.format(PART_TEXT)} AS x FROM part),
m AS (SELECT id, nth, category, skill FROM t JOIN skill ON contains(x, {FOLD.format('skill')}) AND regexp_matches(' ' || x || ' ', '[^a-z0-9]' || regexp_escape({FOLD.format('skill')}) || '[^a-z0-9]'))
SELECT id, count(*) AS n, string_agg(category || ':' || skill, ';' ORDER BY nth) AS skills FROM m GROUP BY id"""
)
def skills_tagging_parts(spark: SparkSession, d: str) -> DataFrame:
    found = dictionary.tagged(part_texts(spark, d), part_skills(spark, d))
    return found.select("id", F.size("skills").cast("long").alias("n"), F.array_join(F.transform("skills", lambda x: F.concat_ws(":", x["category"], x["skill"])), ";").alias("skills"))


@C.add(
    f"""WITH place AS (SELECT DISTINCT p_type AS place FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT unnest(string_split(p_type, ' ')) FROM part),
t AS (SELECT p_partkey AS id, ' ' || {FOLD.format(PART_TEXT)} || ' ' AS x FROM part),
m AS (SELECT id, place, regexp_extract(x, '^(.*?[^a-z0-9])' || regexp_escape({FOLD.format('place')}) || '[^a-z0-9]', 1) AS before FROM t JOIN place ON contains(x, {FOLD.format('place')}))
SELECT id, arg_min(place, (length(before), -length(place), place)) AS place FROM m WHERE before != '' GROUP BY id"""
)
def place_lookup_parts(spark: SparkSession, d: str) -> DataFrame:
    part = views.read(spark, d, "part")
    places = part.select(F.explode(F.array_union(F.array("p_type", "p_brand"), F.split("p_type", " "))).alias("place")).distinct()
    return dictionary.first_place(part_texts(spark, d), places)


@C.add(
    f"""WITH t AS (SELECT p_partkey AS id, {FOLD.format("p_name || ' ' || p_type")} AS x FROM part), f AS (
  SELECT term, min(family) AS family FROM (SELECT {FOLD.format('unnest([p_name, p_type, p_name || chr(32) || p_type, substr(p_type, 2)])')} AS term, p_brand AS family FROM part) GROUP BY term),
m AS (SELECT id, family, term, CASE WHEN x = term THEN 0 ELSE 1 END AS way, CASE WHEN x = term THEN 0 ELSE -length(term) END AS size FROM t JOIN f ON x = term OR length(term) >= 5 AND contains(x, term))
SELECT id, arg_min(family, (way, size, term)) AS family FROM m GROUP BY id"""
)
def job_family_parts(spark: SparkSession, d: str) -> DataFrame:
    part = views.read(spark, d, "part")
    terms = part.select(F.explode(F.array("p_name", "p_type", F.concat_ws(" ", "p_name", "p_type"), F.expr("substr(p_type, 2)"))).alias("term"), F.col("p_brand").alias("family"))
    return dictionary.families(part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text")), terms)
