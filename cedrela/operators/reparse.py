"""Stored texts parsed again by their kind: records of many shapes in one table of variants."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import held
from . import parsers

Parser = Callable[[DataFrame], DataFrame]

#: The parser of each kind; texts of other kinds have no record.
PARSERS: dict[str, Parser] = {
    "cedula": parsers.id_card,
    "salud": parsers.health,
    "liquidacion": parsers.settlement,
    "memorando": parsers.memo,
    "llamado_atencion": parsers.memo,
    "funciones": parsers.job_functions,
}


def reparsed(docs: DataFrame, by_kind: Mapping[str, Parser] | None = None) -> DataFrame:
    """doc_id, category, record (variant) of texts (doc_id, text) that have a parser.

    Texts are read and classified once. The parsers follow each other over the same rows, each with the texts of its kinds and
    null for the others, and what it gives for a text, without doc_id, is the record: a parser gives one row for each doc_id,
    which it passes on.
    """
    by_parser: dict[Parser, list[str]] = {}
    for kind, parser in (by_kind or PARSERS).items():
        by_parser.setdefault(parser, []).append(kind)
    known = classify.classified(docs.select("doc_id", "text")).where(F.col("category").isin([k for kinds in by_parser.values() for k in kinds]))
    rows = known.withColumn("record", F.lit(None).cast("variant"))
    for parser, kinds in by_parser.items():
        own = F.col("category").isin(kinds)
        found = parser(rows.select(F.struct("doc_id", "category", "text", "record").alias("doc_id"), F.when(own, F.col("text")).alias("text")))
        fields = F.struct(*[c for c in found.columns if c != "doc_id"])
        record = F.when(F.col("doc_id.category").isin(kinds), F.to_variant_object(fields)).otherwise(F.col("doc_id.record"))
        rows = held(found, _record=record).select("doc_id.doc_id", "doc_id.category", "doc_id.text", F.col("_record").alias("record"))
    return rows.select("doc_id", "category", "record")


def distinct_records(rows: DataFrame, *key: str) -> DataFrame:
    """The first (by pos) of rows whose record (variant) is the same, within each key.

    Records are the same if they say the same: their JSON, in which a variant's fields stand in the order of their names, is
    compared, so the order in which a parser gives its fields doesn't count. Rows without a record are all kept.
    """
    said = F.to_json("record")
    named = rows.withColumn("_said", said)
    first = named.where("_said IS NOT NULL").groupBy(*key, "_said").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (*key, "record")], F.to_json("record").alias("_record")), "pos").alias("_row"))
    kept = first.select(*key, "_row.*").withColumn("record", F.parse_json("_record")).drop("_record")
    return kept.select(*rows.columns).unionByName(rows.where(F.col("record").isNull()))


def united(parts: list[DataFrame], *key: str) -> DataFrame:
    """Rows (with pos and a record) of several runs as one: those of the first run come first, and of equal records the first
    stays."""
    each = [p.withColumn("pos", F.struct(F.lit(i).alias("run"), F.col("pos").alias("pos"))) for i, p in enumerate(parts)]
    return distinct_records(reduce(DataFrame.unionByName, each), *key)
