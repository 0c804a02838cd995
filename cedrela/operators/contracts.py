"""One record of a contract out of its labels, its prose and, where there is one, its layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from . import geometry, labels, people


def contracts(docs: DataFrame, placed: DataFrame | None = None, not_from: tuple[str, ...] = (), default_notice: int = 30, max_trial: int = 60) -> DataFrame:
    """One record for each contract (doc_id, text): the parties' fields by labels and scopes (labels.contract_parties()), and
    the terms by what the text says (contract_records()), each filling what the other lacks.

    An end that isn't written follows from the start and the months, months from the dates. placed: the documents' lines with
    their places (doc_id, page, col, pos, text, y, y2; layout.reading_order()), so that a label in one column finds its value
    in the other. A null text gives a record of nulls and defaults.
    """
    if placed is None:
        parties = labels.contract_parties(docs, not_from)
    else:
        rows = geometry.in_scopes(placed)
        pairs, dated = geometry.label_pairs(rows)
        parties = labels.contract_parties(docs, not_from, rows.select("doc_id", "pos", "text", "scope"), pairs, dated.select("doc_id", "pos", "text", "scope"))
    terms = people.contract_records(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), default_notice, max_trial)
    both = parties.select(*[F.col(c).alias(f"p_{c}") if c != "doc_id" else F.col(c) for c in parties.columns]).join(terms.select(*[F.col(c).alias(f"t_{c}") if c != "doc_id" else F.col(c) for c in terms.columns]), "doc_id", "left")
    either = lambda c: F.coalesce(f"p_{c}", f"t_{c}")
    day = lambda c: F.coalesce(F.col(f"p_{c}").try_cast("date"), F.col(f"t_{c}"))
    end = F.coalesce(day("end_date"), F.when(F.col("t_contract_type") != "termino_indefinido", F.add_months(day("start_date"), F.col("t_months"))))
    return both.select(
        "doc_id",
        either("employer_name").alias("employer_name"), F.col("p_employer_tax_id").alias("employer_tax_id"), F.col("p_employer_email").alias("employer_email"), F.col("p_employer_address").alias("employer_address"),
        either("worker_name").alias("worker_name"), either("worker_document_number").alias("worker_document_number"), F.col("p_worker_email").alias("worker_email"), F.col("p_worker_address").alias("worker_address"),
        either("position").alias("position"), F.coalesce(F.col("p_salary").cast("long"), F.col("t_salary").cast("long")).alias("salary"), F.col("t_contract_type").alias("contract_type"),
        day("start_date").alias("start_date"), end.alias("end_date"), F.coalesce("t_months", dates.months_between(day("start_date"), end)).alias("months"), F.col("t_trial_days").alias("trial_days"), F.col("t_notice_days").alias("notice_days"),
    )
