"""Queries over stored tables: lookups by either key, and the load cascade for what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..config import DEFAULT
from ..operators import cascade
from ..session import work_dir
from ..sources.tables import Tables
from ..views import key_sql, with_views
from . import Catalogue
from .relational import LINKED, linked_sql

C = Catalogue()


@C.add(
    f"""{with_views('contracts', 'employee_documents')}, c AS (SELECT id, employee_id, {key_sql('worker_document_number')} AS doc_key FROM contracts),
d AS (SELECT id, employee_id, {key_sql('worker_document_number')} AS doc_key FROM employee_documents)
SELECT d.id AS document_id, c.id AS contract_id FROM d JOIN c ON d.employee_id = c.employee_id WHERE d.employee_id IS NOT NULL
UNION ALL SELECT d.id, c.id FROM d JOIN c ON d.doc_key = c.doc_key WHERE d.employee_id IS NULL AND d.doc_key != ''"""
)
def indexed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The contracts of each document's person, by employee or else by number, out of a stored table."""
    tables = Tables(spark, work_dir(spark, "tables"), slots=16)
    tables.write("contracts", cascade.keyed(views.contracts(spark, d)), "employee_id", "doc_key")
    asked = cascade.keyed(views.employee_documents(spark, d)).select(F.col("id").alias("document_id"), "employee_id", "doc_key")
    return tables.lookup("contracts", asked).select("document_id", F.col("found.id").alias("contract_id"))


#: Rows from this day on are what changed since the last load.
SINCE = "1998-01-01"


@C.add(
    f"""{with_views('employees', 'contracts', 'settlements')}, {LINKED}, {linked_sql('settlements', 's', False)}, {linked_sql('contracts', 'c')},
x AS (SELECT linked_id, max(exit_date) AS exit_on_file FROM s WHERE linked_id IS NOT NULL GROUP BY 1),
b AS (SELECT linked_id, max(start_date) AS last_start FROM c WHERE status != 'terminado' GROUP BY 1),
j AS (SELECT e.id AS employee_id, exit_on_file, e.status = 'inactivo' OR (exit_on_file IS NOT NULL AND NOT coalesce(last_start > exit_on_file, false)) AS gone
  FROM employees e LEFT JOIN x ON x.linked_id = e.id LEFT JOIN b ON b.linked_id = e.id),
a AS (SELECT employee_id, count(*) FILTER (WHERE end_date < DATE '{DEFAULT.as_of}') AS n_expired, count(*) FILTER (WHERE end_date >= DATE '{DEFAULT.as_of}') AS n_due
  FROM contracts WHERE status = 'vigente' AND end_date <= DATE '{DEFAULT.as_of}' + {DEFAULT.notice_days} GROUP BY 1)
SELECT employee_id, CASE WHEN gone THEN 'inactivo' ELSE 'activo' END AS status, CASE WHEN gone THEN exit_on_file END AS exit_date,
  CASE WHEN gone THEN CASE WHEN exit_on_file IS NOT NULL THEN 'liquidacion' ELSE 'sin_registrar' END END AS reason,
  CASE WHEN gone THEN 0 ELSE coalesce(n_expired, 0) END AS n_expired, CASE WHEN gone THEN 0 ELSE coalesce(n_due, 0) END AS n_due FROM j LEFT JOIN a USING (employee_id)"""
)
def load_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The load's rows as they were before SINCE, stored, and brought up to date for the contracts and settlements since."""
    employees, contracts, settlements = views.employees(spark, d), views.contracts(spark, d), views.settlements(spark, d)
    path = f"{work_dir(spark, 'load')}/before"
    cascade.load(employees, contracts.where(f"start_date < '{SINCE}'"), settlements.where(f"exit_date < '{SINCE}'"), DEFAULT).write.parquet(path)
    named = lambda rows: rows.select("employee_id", F.col("worker_document_number").alias("document_number"))
    changed = named(contracts.where(f"start_date >= '{SINCE}'")).unionByName(named(settlements.where(f"exit_date >= '{SINCE}'")))
    return cascade.reload(spark.read.parquet(path), employees, contracts, settlements, changed, DEFAULT)
