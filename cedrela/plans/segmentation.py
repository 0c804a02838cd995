"""Glued words over all documents; in SQL all ways through a word are tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import segmentation as seg
from . import Catalogue
from .fields import PLAIN

C = Catalogue()

SPLITS = f"""RECURSIVE w AS (
  SELECT doc_id, unnest(string_split_regex({PLAIN.format('text')}, '[^a-z]+')) AS word FROM documents
), counted AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w WHERE word != '' GROUP BY word
), priced AS (SELECT *, CAST(round({seg.SCALE} * (ln(sum(n) OVER ()) - ln(n))) AS BIGINT) AS cost FROM counted
), known AS (SELECT word AS piece, length(word) AS size, cost AS price FROM priced WHERE length(word) BETWEEN {seg.SHORTEST} AND {seg.LONGEST} AND docs >= {seg.MIN_DOCS}
), glued AS (SELECT word, length(word) AS size, cost AS own FROM priced WHERE length(word) >= {seg.GLUED}
), way AS (
  SELECT word, 0 AS place, CAST(0 AS BIGINT) AS cost, CAST([] AS VARCHAR[]) AS parts, CAST([] AS BIGINT[]) AS ends FROM glued
  UNION ALL
  SELECT y.word, y.place + k.size, y.cost + k.price, list_append(y.parts, k.piece), list_append(y.ends, y.place + k.size) FROM way y, (SELECT unnest(range({seg.SHORTEST}, {seg.LONGEST} + 1)) AS size) s
    JOIN known k ON k.size = s.size AND k.piece = substr(y.word, CAST(y.place + 1 AS BIGINT), CAST(s.size AS BIGINT))
    WHERE y.place + s.size <= length(y.word) AND s.size < length(y.word)
), best AS (
  SELECT word, arg_min(parts, (cost, len(parts), ends)) AS parts, min(cost) AS cost FROM way WHERE place = length(word) GROUP BY word
)"""


@C.add(f"WITH {SPLITS} SELECT word, array_to_string(parts, ' ') AS parts, cost, own FROM best JOIN glued USING (word) WHERE cost < own")
def glued_words_documents(spark: SparkSession, d: str) -> DataFrame:
    found = seg.splits(seg.words_of(views.read(spark, d, "documents")))
    return found.select("word", F.array_join("parts", " ").alias("parts"), "cost", "own")


@C.add()
def cleaned_texts_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with glued words split; tests hold it against plain Python."""
    docs = views.read(spark, d, "documents")
    out = seg.cleaned(docs, seg.splits(seg.words_of(docs)))
    return out.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "separations")
