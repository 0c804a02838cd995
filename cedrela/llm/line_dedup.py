"""Removal of boilerplate lines by the number of sites that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stage, table

#: A line on so many sites is boilerplate.
MIN_SITES = 5
#: Logarithm of the sketch's size. The relative error is about 1.04 / sqrt(2**LOG_SIZE).
LOG_SIZE = 10
#: Estimates nearer to the threshold than so many standard errors are counted exactly.
SURE = 6


def row_of(text: Column, source: Column) -> Column:
    """What tells rows of one doc_id apart: rows equal in text and source are one row."""
    return F.xxhash64(F.struct(text, source))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row, source, pos, line (64-bit hash) of every line with more than spaces in it."""
    parts = docs.select("doc_id", "row", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return parts.select("doc_id", "row", "source", "pos", F.trim("line").alias("line")).where("line != ''").withColumn("line", F.xxhash64("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line, first (doc_id, row, pos) of the lines that stand on at least `min_sites` distinct sites.

    A HyperLogLog sketch of the sites is built for each line hash and merged by the aggregation. Estimates clear of the
    threshold decide; the lines near it get their sites counted exactly.
    """
    shown = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("source"), LOG_SIZE)).alias("sites"),
        F.count("*").alias("n"),
        F.min(F.struct("doc_id", "row", "pos")).alias("first"),
    )
    margin = SURE * 1.04 / (1 << LOG_SIZE) ** 0.5 * min_sites
    open_ = stage(shown.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - max(margin, 1))))
    sure = open_.where(F.col("sites") > min_sites + max(margin, 1))
    near = open_.where(F.col("sites") <= min_sites + max(margin, 1))
    exact = (
        lines.join(near.select("line"), "line", "left_semi")
        .select("line", "source")
        .distinct()
        .groupBy("line")
        .agg(F.count("source").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    kept = sure.unionByName(near.join(exact.select("line"), "line", "left_semi"))
    return kept.select("line", "first")


def removed_lines(docs: DataFrame, min_sites: int) -> DataFrame:
    """doc_id, row, removed (sorted positions, from 0) of the documents (doc_id, row, text, source) that lose lines."""
    lines = lines_of(docs)
    hit = lines.select("doc_id", "row", "pos", "line").join(boilerplate(lines, min_sites), "line")
    gone = hit.where(F.struct("doc_id", "row", "pos") != F.col("first"))
    return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def kept_of(parts: str, removed: str) -> Column:
    """The text of the lines `parts` (a column, not an expression: lines are taken out of it by position) without some."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), removed)
    return F.array_join(F.when(F.col(removed).isNull(), F.col(parts)).otherwise(F.transform(stay, lambda i: F.get(parts, i))), "\n")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, removed (positions, from 0), kept_text of every document.

    A line is what stands between line feeds, without spaces at its ends; blank lines are never boilerplate. Of a
    boilerplate line, the first occurrence (smallest doc_id, then position) stays and every other is removed.

    Cases: a null or empty text has no lines and an empty kept_text. Null sources are no site. A null doc_id comes first and
    its lines are never removed. Rows that repeat a doc_id are judged each by itself, in the order of a hash of text and
    source; rows equal in all three are one, and lose the same lines. Other columns are ignored; an empty table gives an
    empty result. Work by line is aggregated before it is shuffled; the joins by line and by document are those that Spark
    splits when a key is hot.
    """
    docs = pick(docs, "doc_id", "text", "source").withColumn("row", row_of(F.col("text"), F.col("source")))
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    out = docs.select("doc_id", "row", parts.alias("parts")).join(removed_lines(docs, min_sites), ["doc_id", "row"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("parts") == F.array(F.lit("")), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        kept_of("parts", "removed").alias("kept_text"),
    )


def clean_documents(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents, all columns kept, with the lines that without_boilerplate() finds removed from text (and n_chars, if
    there, brought up to date where lines went)."""
    names = docs.columns
    at = {x: f"c{names.index(x)}" for x in ("doc_id", "text", "source")}
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = plain.withColumn("row", row_of(F.col(at["text"]), F.col(at["source"])))
    gone = removed_lines(rows.select("row", *[F.col(c).alias(x) for x, c in at.items()]), min_sites).withColumnRenamed("row", "of_row")
    parts = rows.withColumn(at["text"], F.split(at["text"], "\n", -1))
    out = parts.join(gone, (F.col(at["doc_id"]) == F.col("doc_id")) & (F.col("row") == F.col("of_row")), "left")
    out = out.withColumn(at["text"], kept_of(at["text"], "removed"))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        out = out.withColumn(size, F.when(F.col("removed").isNull(), F.col(size)).otherwise(F.length(at["text"]).cast("long")))
    return out.select(*plain.columns).toDF(*names)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


#: The sites are counted exactly here.
OP5_SQL = f"""
WITH part AS (
  SELECT doc_id, source, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS line, len(p) AS n
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND text != '')
), boiler AS (
  SELECT trim(line) AS line, min((doc_id, pos)) AS first FROM part WHERE trim(line) != ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT p.doc_id, p.pos, p.line, b.line IS NOT NULL AND (p.doc_id, p.pos) != b.first AS gone
  FROM part p LEFT JOIN boiler b ON b.line = trim(p.line)
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
