"""Candidates against weighted requirements of vacancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from . import dictionary

#: Fields that a requirement's type looks at.
FIELDS = {"habilidad": ["skills"], "experiencia": ["headline", "skills"], "educacion": ["education"], "otro": ["skills", "headline", "education", "city"]}


def match_scores(candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """candidate_id, vacancy_id, score (0 to 100, one decimal), n_matched of every candidate for every vacancy.

    candidates: id, skills, headline, education, city; requirements: vacancy_id, skill_or_req, weight, req_type. A
    requirement counts at least 1; blank ones count nothing; it is met when its folded text stands in the fields of its
    type. Requirements are first gathered by vacancy, so each candidate meets a vacancy once and nothing is shuffled by
    candidate: the number of vacancies is the factor by which the result itself exceeds the candidates.
    """
    terms = requirements.where(F.trim("skill_or_req") != "")
    weight = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))
    listed = terms.groupBy("vacancy_id").agg(F.collect_list(F.struct(fold(F.col("skill_or_req")).alias("term"), weight.alias("weight"), "req_type")).alias("terms"))
    text = {k: F.concat_ws(" ", *[fold(F.col(n)) for n in names]) for k, names in FIELDS.items()}
    people = candidates.select(F.col("id").alias("candidate_id"), F.create_map(*[x for k, c in text.items() for x in (F.lit(k), c)]).alias("text"))
    pairs = people.join(listed, F.lit(True), "inner")
    met = lambda t: F.contains(F.coalesce(F.try_element_at("text", t["req_type"]), F.element_at("text", F.lit("otro"))), t["term"])
    total = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + t["weight"])
    earned = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.when(met(t), t["weight"]).otherwise(0))
    score = F.when(total > 0, F.round(F.lit(1000.0) * earned / total) / 10).otherwise(F.lit(0.0))
    return pairs.select("candidate_id", "vacancy_id", score.alias("score"), F.size(F.filter("terms", met)).cast("long").alias("n_matched"))


def top_matches(scores: DataFrame, n: int = 10) -> DataFrame:
    """Each vacancy's n best, ties by candidate. Spark keeps n rows of a vacancy in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("vacancy_id").orderBy(F.desc("score"), "candidate_id"))
    return scores.withColumn("place", place).where(F.col("place") <= n)


#: Letters of the requirements that are looked for in one reading.
BLOCK = dictionary.BLOCK


def best_matches(candidates: DataFrame, requirements: DataFrame, n: int = 10) -> DataFrame:
    """top_matches(match_scores()) without the pairs that meet nothing: vacancy_id, candidate_id, score, n_matched, place.

    All distinct requirements are found in a candidate's fields in one reading (dictionary.occurrences()), whatever their number
    and that of the vacancies that have them; only hits go on, and join the requirements of vacancies by their text. A vacancy with fewer than n such candidates is filled up
    with the first of the others, all of which are among the first 2 n candidates.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long")
    kind = F.when(F.col("req_type").isin(*FIELDS), F.col("req_type")).otherwise("otro")
    terms = requirements.where(F.trim("skill_or_req") != "").select("vacancy_id", weight.alias("weight"), fold(F.col("skill_or_req")).alias("term"), kind.alias("kind"))
    distinct = terms.select("kind", "term").distinct()
    text = {k: F.concat_ws(" ", *[fold(F.col(c)) for c in names]) for k, names in FIELDS.items()}
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in text.items()])).alias("f")
    texts = candidates.select(F.col("id").alias("candidate_id"), fields).select(F.struct("candidate_id", "f.kind").alias("id"), "f.text")
    hits = dictionary.occurrences(texts, distinct, words=False, block=BLOCK).select("id.candidate_id", "id.kind", "term")
    earned = dictionary.with_terms(hits, terms, "kind", "term").groupBy("vacancy_id", "candidate_id").agg(F.sum("weight").alias("earned"), F.count("*").alias("n_matched"))

    totals = terms.groupBy("vacancy_id").agg(F.sum("weight").alias("total"))
    first = candidates.select(F.col("id").alias("candidate_id")).orderBy("candidate_id").limit(2 * n).agg(F.collect_list("candidate_id").alias("ids"))
    rest = totals.select("vacancy_id").withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one").select("vacancy_id", F.explode("ids").alias("candidate_id"))
    rest = rest.join(earned, ["vacancy_id", "candidate_id"], "left_anti").select("vacancy_id", "candidate_id", F.lit(0).cast("long").alias("earned"), F.lit(0).cast("long").alias("n_matched"))
    scored = earned.unionByName(rest).join(totals, "vacancy_id").withColumn("score", F.round(F.lit(1000.0) * F.col("earned") / F.col("total")) / 10)
    return top_matches(scored.select("candidate_id", "vacancy_id", "score", "n_matched"), n)
