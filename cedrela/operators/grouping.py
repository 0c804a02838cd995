"""Documents of one person: exact keys, similar names, and a person's record out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_tokens
from ..views import document_key


def _meetings(names: DataFrame, known: bool) -> DataFrame:
    """names (a column `tokens`, and others) with each `at` under which it meets the similar names of the other side.

    Two names of two tokens or more are similar by a pair of them; one of a single token is similar to every name with it.
    """
    t = F.col("tokens")
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.concat_ws(" ", x, y))))
    of_single = F.transform(t, lambda x: F.concat(F.lit("1 "), x))  # meets known names of this token only
    to_single = F.transform(t, lambda x: F.concat(F.lit("n "), x))  # meets loose names of this token only
    alone = F.size(t) == 1
    at = F.when(alone, F.concat(of_single, to_single)).otherwise(F.concat(pairs, to_single)) if known else F.when(alone, to_single).otherwise(F.concat(pairs, of_single))
    return names.withColumn("at", F.explode(at)).drop("tokens")


def entity_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group: documents (doc_id, pos, name, document_number) of one person.

    Those with a document number go by it. One with only a name joins the person of a similar name (same_person()) whose
    first document comes first; names alone go by equal token sets. What has neither is `sin identificar`. The definition
    doesn't depend on how the batch is partitioned, and no pair of names is made: a key of tokens has one first person, and
    a name takes the first of its keys.
    """
    tokens = F.array_sort(name_tokens(F.col("name")))
    rows = docs.withColumn("key", F.nullif(document_key(F.col("document_number")), F.lit("")))
    known = rows.where("key IS NOT NULL AND name IS NOT NULL").groupBy("key").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("known_pos"))
    first = _meetings(known.select(tokens.alias("tokens"), F.struct("known_pos", "key").alias("person")), True).groupBy("at").agg(F.min("person").alias("person"))
    loose = rows.where("key IS NULL AND name IS NOT NULL").select("doc_id", tokens.alias("tokens"))
    met = _meetings(loose.select("tokens").distinct().withColumn("label", F.array_join("tokens", " ")), False).join(first, "at")
    labels = met.groupBy("label").agg(F.min("person").alias("person"))
    linked = loose.withColumn("label", F.array_join("tokens", " ")).join(labels, "label").groupBy("doc_id").agg(F.min("person")["key"].alias("found"))
    label = F.array_join(tokens, " ")
    out = rows.join(linked, "doc_id", "left")
    group = F.when(F.col("key").isNotNull(), F.concat(F.lit("id:"), "key")).when(F.col("found").isNotNull(), F.concat(F.lit("id:"), "found")).when(label != "", F.concat(F.lit("name:"), label)).otherwise("sin identificar")
    return out.select("doc_id", group.alias("group"))


def person_record(docs: DataFrame, key: str = "group") -> DataFrame:
    """One row for each group: the first name, the last of what changes (phone, city), the most frequent kind (ties: first
    seen), mean confidence, total size, the distinct positions in order."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = docs.groupBy(key, "kind").agg(F.count("*").alias("n"), F.min("pos").alias("p")).groupBy(key).agg(F.max_by("kind", F.struct("n", -F.col("p"))).alias("kind"))
    base = docs.select(
        key, "pos", "confidence", "size",
        F.first("name", ignorenulls=True).over(w).alias("first_name"), F.last("city", ignorenulls=True).over(w).alias("last_city"),
    )
    out = base.groupBy(key).agg(F.count("*").alias("n"), F.min("first_name").alias("name"), F.max("last_city").alias("city"), F.avg("confidence").alias("confidence"), F.sum("size").alias("size"))
    return out.join(kinds, key)
