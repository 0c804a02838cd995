"""The case file: documents in sections, one for each person, by pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..views import document_key
from . import history
from .history import by_either_key


def sections(documents: DataFrame, employees: DataFrame) -> DataFrame:
    """section, title, anonymous, n_documents, last_id: documents grouped by linked employee, else by name and document."""
    names = employees.select(F.col("id").alias("linked_id"), "full_name")
    rows = by_either_key(documents, employees).join(names, "linked_id", "left")
    anonymous = F.col("linked_id").isNull()
    key = F.when(anonymous, F.concat(F.lit("anon:"), F.coalesce("worker_name", F.lit("")), F.lit("|"), F.coalesce("worker_document_number", F.lit("")))).otherwise(F.concat(F.lit("emp:"), "linked_id"))
    title = F.when(anonymous, F.coalesce("worker_name", "worker_document_number", F.lit("Sin identificar"))).otherwise(F.col("full_name"))
    return rows.select(key.alias("section"), title.alias("title"), anonymous.alias("anonymous"), "id").groupBy("section", "title", "anonymous").agg(F.count("*").alias("n_documents"), F.max("id").alias("last_id"))


def page(found: DataFrame, number: int, per_page: int = 6, spanish: bool = True) -> DataFrame:
    """One page (from 0) of the sections, linked ones first, then by title in Spanish order. Only the rows up to the page's
    end are kept by each task."""
    order = [F.col("anonymous"), F.collate("title", "es") if spanish else F.col("title"), F.col("section")]
    return found.orderBy(*order).limit((number + 1) * per_page).offset(number * per_page)


def filtered(documents: DataFrame, employees: DataFrame, employee_id: int | None = None, document: str | None = None) -> DataFrame:
    """Documents of one employee (by id, or by document if they have no id), or those that link to nobody."""
    linked = by_either_key(documents, employees)
    return linked.where(F.col("linked_id").isNull() if employee_id is None else F.col("linked_id") == employee_id)


def details(documents: DataFrame, contracts: DataFrame, settlements: DataFrame, memoranda: DataFrame, n_memos: int = 3) -> DataFrame:
    """document_id, kind, nth, record_id: what a document of the case file shows, by its category: the first contract or the
    first settlement (by id) with its number, or the last memos of its employee, the latest first.

    Contracts and settlements are reduced to one for each number, and memos to n_memos for each employee, before they meet
    the documents. Documents without a number, or an employee, show nothing.
    """
    key = lambda c: F.nullif(document_key(F.col(c)), F.lit(""))
    docs = documents.select(F.col("id").alias("document_id"), "category", "employee_id", key("worker_document_number").alias("doc_key"))
    first = lambda rows, kind: rows.select(key("worker_document_number").alias("doc_key"), "id").where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.min("id").alias("record_id")).withColumn("kind", F.lit(kind))
    one = first(contracts, "contrato").unionByName(first(settlements, "liquidacion"))
    by_number = docs.join(one, (docs["doc_key"] == one["doc_key"]) & (docs["category"] == one["kind"])).select("document_id", "kind", F.lit(1).alias("nth"), "record_id")
    latest = history.last_memos(memoranda, n_memos).select("employee_id", F.col("place").alias("nth"), F.col("id").alias("record_id"))
    memos = docs.where(F.col("category").isin("memorando", "llamado_atencion")).join(latest, "employee_id").select("document_id", F.lit("memo").alias("kind"), "nth", "record_id")
    return by_number.unionByName(memos)
