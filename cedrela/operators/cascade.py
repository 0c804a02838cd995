"""What is derived when data is loaded: status from evidence, then alerts; as a whole or for what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..views import document_key
from . import alerts, history


def load(employees: DataFrame, contracts: DataFrame, settlements: DataFrame, settings: Settings) -> DataFrame:
    """employee_id, status, exit_date, reason, n_expired, n_due: status from the evidence, and on it the contract alerts."""
    status = history.employment_status(employees, contracts, settlements)
    people = employees.drop("status").join(status.select(F.col("employee_id").alias("id"), "status"), "id")
    found = alerts.contract_alerts(people, contracts, settings).groupBy("employee_id")
    counted = found.agg(F.count_if(F.col("alert_type") == "contrato_vencido").alias("n_expired"), F.count_if(F.col("alert_type") == "vencimiento_contrato").alias("n_due"))
    return status.join(counted, "employee_id", "left").fillna(0, ["n_expired", "n_due"])


def keyed(rows: DataFrame, document: str = "worker_document_number") -> DataFrame:
    """rows with doc_key, null where there is no number."""
    return rows.withColumn("doc_key", F.nullif(document_key(F.col(document)), F.lit("")))


def touching(rows: DataFrame, ids: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """rows (with doc_key) whose `key` is in ids (column of that name) or whose doc_key is in numbers."""
    by_id = ids.select(key).distinct().withColumn("_i", F.lit(True))
    by_number = numbers.select("doc_key").distinct().withColumn("_n", F.lit(True))
    return rows.join(by_id, key, "left").join(by_number, "doc_key", "left").where("_i OR _n").drop("_i", "_n")


def reload(previous: DataFrame, employees: DataFrame, contracts: DataFrame, settlements: DataFrame, changed: DataFrame, settings: Settings) -> DataFrame:
    """The rows of load() over the tables as they are now, out of its rows before a change (`previous`).

    changed: employee_id and document_number of every row that came, went or differs, as it was and as it is: of a
    contract, a settlement, or an employee. Only employees that such a row may belong to are computed anew, from the rows
    that may belong to them, and the employees that these rows name; all other rows are taken over.
    """
    people = keyed(employees, "document_number")
    told = keyed(changed, "document_number")
    affected = touching(people, told.select(F.col("employee_id").alias("id")).where("id IS NOT NULL"), told.where("doc_key IS NOT NULL"), "id")
    ids, numbers = affected.select(F.col("id").alias("employee_id")), affected.where("doc_key IS NOT NULL").select("doc_key")
    near = [touching(keyed(rows), ids, numbers, "employee_id") for rows in (contracts, settlements)]
    named = near[0].select("employee_id", "doc_key").unionByName(near[1].select("employee_id", "doc_key")).unionByName(affected.select(F.col("id").alias("employee_id"), "doc_key"))
    linking = touching(people, named.select(F.col("employee_id").alias("id")).where("id IS NOT NULL"), named.where("doc_key IS NOT NULL"), "id")
    anew = load(linking.select(*employees.columns), near[0].select(*contracts.columns), near[1].select(*settlements.columns), settings)
    stay = previous.join(told.select("employee_id").where("employee_id IS NOT NULL").unionByName(ids).distinct(), "employee_id", "left_anti")
    return stay.unionByName(anew.join(ids, "employee_id", "left_semi"))
