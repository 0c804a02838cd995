"""Field accuracy: comparison states, cube, correlation, taxonomy of errors and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compare


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, key, expected, got: arrays of text) with score and state.

    The key's ending says how: `#` compares the number of elements, `[]` lists, `~` containment, nothing text or digits.
    """
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    key, e, g = F.col("key"), F.col("expected"), F.col("got")
    score = (
        F.when(key.endswith("#"), compare.count_ratio(first(e).try_cast("double"), F.size(g)))
        .when(F.contains(key, F.lit("[]")), compare.list_similarity(e, g))
        .when(key.endswith("~"), compare.containment(first(e), first(g)))
        .otherwise(compare.text_similarity(key, first(e), first(g)))
    )
    out = pairs.withColumn("score", score)
    return out.withColumn("state", compare.state(F.col("score"), F.array_join(g, " ")))


def cube(rows: DataFrame) -> DataFrame:
    """key, template, profile (null: all), n, hits, near, rate, mean_score over each and over all, in one pass."""
    rows.createOrReplaceTempView("accuracy_rows")
    return rows.sparkSession.sql(
        """SELECT key, template, profile, grouping_id() AS level, count(*) AS n, count_if(state = 'acierto') AS hits, count_if(state = 'casi') AS near,
           count_if(state = 'acierto') / count(*) AS rate, avg(score) AS mean_score
           FROM accuracy_rows GROUP BY GROUPING SETS ((key), (template), (profile), ())"""
    )


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's coefficient, 0 where one of the two doesn't vary."""
    below = F.sqrt(F.greatest(F.var_pop(x) * F.var_pop(y), F.lit(1e-9)))
    return rows.agg(F.count("*").alias("n"), (F.covar_pop(x, y) / below).alias("correlation"))


def taxonomy(rows: DataFrame) -> DataFrame:
    """key, kind, n, share: errors of each field by kind."""
    e, g = F.array_join("expected", " "), F.array_join("got", " ")
    kind = F.when(F.trim(g) == "", "vacio").when(F.contains(g, e) | F.contains(e, g), "parcial").when(F.length(g) > 2 * F.length(e), "exceso").otherwise("distinto")
    n = rows.where("state NOT IN ('acierto')").groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))
    total = n.groupBy("key").agg(F.sum("n").alias("total"))
    return n.join(total, "key").select("key", "kind", "n", F.try_divide("n", "total").alias("share"))


def gate(rows: DataFrame, least_rate: float) -> DataFrame:
    return rows.agg(F.count_if(F.col("state") == "acierto").alias("hits"), F.count("*").alias("n")).select("hits", "n", (F.try_divide("hits", "n") >= least_rate).alias("passed"))
