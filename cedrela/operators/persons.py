"""Documents of one person over any number of hops of similar names, and one record out of a person's documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import name_tokens
from ..session import work_dir
from ..views import document_key

#: Fixed value: the group of what has neither a number nor a name.
UNKNOWN = "sin identificar"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as files of the shared folder, parted by some columns: what comes before isn't computed again."""
    path = work_dir(df.sparkSession, "persons")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b; strings) reaches.

    Each node knows a smaller one or itself. A round gives every node the smallest that a neighbour knows, and then what
    that one knows (pointers are followed two at a time), until nothing changes: the rounds grow with the logarithm of the
    longest way. A node's neighbours are only ever aggregated.
    """
    both = edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both)
    known = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(known, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        better = known.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "seen").alias("root"))
        # Also tell the old root: whoever points there learns of the smaller one through it.
        told = better.where("root < before").groupBy(F.col("before").alias("node")).agg(F.min("root").alias("told"))
        told = better.join(told, "node", "left").select("node", "before", F.least("root", F.coalesce("told", "root")).alias("root"))
        hop = told.select(F.col("node").alias("root"), F.col("root").alias("hop"))
        now = written(told.join(hop, "root", "left").select("node", F.least("root", F.coalesce("hop", "root")).alias("root"), (F.least("root", F.coalesce("hop", "root")) != F.col("before")).alias("changed")))
        known = now.select("node", "root")
        if now.where("changed").isEmpty():
            return known


def name_label(name: Column) -> Column:
    """What makes names equal: their tokens in order; null without any."""
    return F.nullif(F.array_join(F.array_sort(name_tokens(name)), " "), F.lit(""))


def similar_names(labels: DataFrame) -> DataFrame:
    """Edges a, b between names (column label, distinct) that share two tokens or more.

    Every pair of a name's tokens is a key; the names of a key are all similar, so each is tied to the key's smallest name:
    as many edges as keys, however many names a key has, and no pair of names is tested.
    """
    at = labels.select("label", F.split("label", " ").alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.concat_ws(" ", x, y))))
    keys = at.where(F.size("t") > 1).select("label", F.explode(F.array_distinct(pairs)).alias("key"))
    first = keys.groupBy("key").agg(F.min("label").alias("a"))
    return keys.join(first, "key").select("a", F.col("label").alias("b")).where("a != b").distinct()


def person_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group of documents (doc_id, pos, name, document_number).

    A document with a number belongs to the number. Names are one person's when they share two tokens, over any number of
    hops; documents with such a name and no number belong to the number that comes first (pos) among these names, else to
    the names' group. What has neither goes to the only group, if there is just one, else to `sin identificar`. Numbers
    are never joined by names.
    """
    rows = docs.select("doc_id", "pos", F.nullif(document_key(F.col("document_number")), F.lit("")).alias("key"), name_label(F.col("name")).alias("label"))
    labels = rows.where("label IS NOT NULL").select("label").distinct()
    person = smallest_reachable(similar_names(labels)).select(F.col("node").alias("label"), F.col("root").alias("person"))
    rows = rows.join(person, "label", "left").withColumn("person", F.coalesce("person", "label"))
    numbers = rows.where("key IS NOT NULL AND person IS NOT NULL").groupBy("person").agg(F.min_by("key", F.struct("pos", "key")).alias("found"))
    group = F.coalesce(F.concat(F.lit("id:"), F.coalesce("key", "found")), F.concat(F.lit("name:"), "person"))
    out = rows.join(numbers, "person", "left").select("doc_id", group.alias("group"))
    few = [r["group"] for r in out.where("group IS NOT NULL").select("group").distinct().limit(2).collect()]
    return out.fillna({"group": few[0] if len(few) == 1 else UNKNOWN})


def first_of(column: str) -> Column:
    """The first value in the order of pos that isn't null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct("pos", F.col(column)))).alias(column)


def last_of(column: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.struct("pos", F.col(column)))).alias(column)


def synthesis(docs: DataFrame, key: str, first: Sequence[str] = (), last: Sequence[str] = (), total: Sequence[str] = (), mean: Sequence[str] = (), mode: Sequence[str] = (), joined: Sequence[str] = ()) -> DataFrame:
    """One row for each `key` of documents (with pos): of some columns the first or the last value that isn't null, of some
    the sum or the mean, of some the most frequent value (ties: first seen), some texts joined in order with a blank line
    between; and n.

    All but the texts are aggregated before they are shuffled; texts are gathered by person, as they are to be parsed as one,
    in one task each. For what is only to tell them apart, digests.joined_sha256() gathers none.
    """
    texts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("x"))))), lambda x: x["x"]), "\n\n").alias(c) for c in joined]
    out = docs.groupBy(key).agg(F.count("*").alias("n"), *map(first_of, first), *map(last_of, last), *[F.sum(c).alias(c) for c in total], *[F.avg(c).alias(c) for c in mean], *texts)
    for c in mode:
        counts = docs.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count("*").alias("_n"), F.min("pos").alias("_p"))
        out = out.join(counts.groupBy(key).agg(F.max_by(c, F.struct("_n", -F.col("_p"))).alias(c)), key, "left")
    return out


def experience(rows: DataFrame, key: str) -> DataFrame:
    """key, experience: jobs (pos, position, company) by position, the first of each, in order; the first of all is current."""
    each = rows.where("position IS NOT NULL").groupBy(key, "position").agg(F.min("pos").alias("at"), F.min_by("company", "pos").alias("company"))
    jobs = F.array_sort(F.collect_list(F.struct("at", "position", "company")))
    return each.groupBy(key).agg(F.transform(jobs, lambda x, i: F.struct(x["position"].alias("position"), x["company"].alias("company"), (i == 0).alias("is_current"))).alias("experience"))


def largest_group(groups: DataFrame) -> DataFrame:
    """The group (column group) with the most documents, and how many; ties: the one that comes first by name."""
    return groups.groupBy("group").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group").limit(1)
