"""Linking by two keys, employment status, histories and their windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..views import document_key


#: Parts over which rows without a key are spread.
SPREAD = 256


def by_either_key(rows: DataFrame, employees: DataFrame, id_first: bool = True) -> DataFrame:
    """rows with `linked_id`: the employee by employee_id, else by normalised document.

    id_first: a row with an employee_id is never looked up by document, even if that id is unknown. Two equi-joins stand for
    the OR. Of employees that share a document, the smallest id counts.
    """
    known = employees.select(F.col("id").alias("employee_id"), F.col("id").alias("by_id"), F.col("id").isNull().cast("int").alias("_a"))
    numbers = employees.select(document_key(F.col("document_number")).alias("doc_key"), "id").where("doc_key != ''")
    numbers = numbers.groupBy("doc_key").agg(F.min("id").alias("by_document")).withColumn("_b", F.col("by_document").isNull().cast("int"))
    # Rows without a key match nothing; so that they don't meet in one task, they are spread by what else they hold. The other
    # side's 0 is no literal: Spark would take a literal out of the keys.
    apart = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(SPREAD)).cast("int") + 1
    keyed = rows.withColumn("doc_key", document_key(F.col("worker_document_number")))
    keyed = keyed.withColumns({"_a": F.when(F.col("employee_id").isNull(), apart).otherwise(0), "_b": F.when(F.coalesce("doc_key", F.lit("")) == "", apart).otherwise(0)})
    out = keyed.join(known, ["employee_id", "_a"], "left").join(numbers, ["doc_key", "_b"], "left").drop("_a", "_b")
    other = F.when(F.col("employee_id").isNull(), F.col("by_document")) if id_first else F.col("by_document")
    return out.withColumn("linked_id", F.coalesce("by_id", other)).drop("doc_key", "by_id", "by_document")


def person_contracts(employees: DataFrame, contracts: DataFrame) -> DataFrame:
    """employee_id, contract_id, via: each employee's contracts by id, and by document those that aren't among them."""
    by_id = contracts.join(employees.select(F.col("id").alias("employee_id")), "employee_id").select("employee_id", F.col("id").alias("contract_id"), F.lit("id").alias("via"))
    numbers = employees.select(F.col("id").alias("employee_id"), document_key(F.col("document_number")).alias("doc_key"))
    by_number = contracts.select(F.col("id").alias("contract_id"), document_key(F.col("worker_document_number")).alias("doc_key")).join(numbers, "doc_key")
    more = by_number.join(by_id, ["employee_id", "contract_id"], "left_anti").select("employee_id", "contract_id", F.lit("document").alias("via"))
    return by_id.unionByName(more)


def person_history(employees: DataFrame, contracts: DataFrame, memoranda: DataFrame, documents: DataFrame) -> DataFrame:
    """employee_id, n_contracts, n_by_document, first_start, n_memos, n_documents of every employee."""
    linked = person_contracts(employees, contracts).join(contracts.select(F.col("id").alias("contract_id"), "start_date"), "contract_id")
    c = linked.groupBy("employee_id").agg(F.count("*").alias("n_contracts"), F.count_if(F.col("via") == "document").alias("n_by_document"), F.min("start_date").alias("first_start"))
    m = memoranda.groupBy("employee_id").agg(F.count("*").alias("n_memos"))
    d = by_either_key(documents, employees).groupBy(F.col("linked_id").alias("employee_id")).agg(F.count("*").alias("n_documents"))
    out = employees.select(F.col("id").alias("employee_id"))
    for part in (c, m, d):
        out = out.join(part, "employee_id", "left")
    return out.fillna(0, ["n_contracts", "n_by_document", "n_memos", "n_documents"])


def employment_status(employees: DataFrame, contracts: DataFrame, settlements: DataFrame) -> DataFrame:
    """employee_id, status, exit_date, reason after the evidence on file.

    An exit (the latest settlement, by id or document) makes an active employee inactive, unless a contract starts after it:
    a rehire counts from its own start, so it isn't undone by the older exit. An inactive employee only gets what is missing.
    """
    exits = by_either_key(settlements, employees, id_first=False).where("linked_id IS NOT NULL")
    last = exits.groupBy(F.col("linked_id").alias("employee_id")).agg(F.max("exit_date").alias("exit_on_file"))
    starts = by_either_key(contracts, employees).where("linked_id IS NOT NULL AND status != 'terminado'").groupBy(F.col("linked_id").alias("employee_id")).agg(F.max("start_date").alias("last_start"))
    both = employees.select(F.col("id").alias("employee_id"), "status").join(last, "employee_id", "left").join(starts, "employee_id", "left")
    gone = (F.col("status") == "inactivo") | (F.col("exit_on_file").isNotNull() & ~F.coalesce(F.col("last_start") > F.col("exit_on_file"), F.lit(False)))
    return both.select(
        "employee_id",
        F.when(gone, "inactivo").otherwise("activo").alias("status"),
        F.when(gone, F.col("exit_on_file")).alias("exit_date"),
        F.when(gone, F.when(F.col("exit_on_file").isNotNull(), "liquidacion").otherwise("sin_registrar")).alias("reason"),
    )


def current_role(contracts: DataFrame) -> DataFrame:
    """employee_id, contract_id, contract_type: the contract in force, else the one that started last."""
    order = [F.when(F.col("status") == "vigente", 0).otherwise(1), F.desc("start_date"), F.col("id")]
    first = F.row_number().over(Window.partitionBy("employee_id").orderBy(*order))
    return contracts.where("employee_id IS NOT NULL").withColumn("nth", first).where("nth = 1").select("employee_id", F.col("id").alias("contract_id"), "contract_type")


def timeline(events: DataFrame) -> DataFrame:
    """employee_id, nth, event_type, since_last: each employee's events in order, with the seconds since the one before."""
    w = Window.partitionBy("employee_id").orderBy("ts", "id")
    gap = F.date_diff(F.col("ts"), F.lag("ts").over(w))
    return events.select("employee_id", "id", "event_type", F.row_number().over(w).alias("nth"), gap.alias("days_since"))


def last_memos(memoranda: DataFrame, n: int = 3) -> DataFrame:
    latest = F.row_number().over(Window.partitionBy("employee_id").orderBy(F.desc("ts"), F.desc("id")))
    return memoranda.withColumn("place", latest).where(F.col("place") <= n).select("employee_id", "place", "id")


def running_memos(memoranda: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("employee_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    return memoranda.select("id", "employee_id", n.alias("memo_count"))


def fill_links(rows: DataFrame, employees: DataFrame, first_only: bool = False) -> DataFrame:
    """id, employee_id: rows without an employee get the one with their document; first_only: only each document's first."""
    out = by_either_key(rows, employees)
    if first_only:
        nth = F.row_number().over(Window.partitionBy(F.col("employee_id").isNull(), document_key(F.col("worker_document_number"))).orderBy("id"))
        out = out.withColumn("linked_id", F.when(F.col("employee_id").isNotNull() | (nth == 1), F.col("linked_id")))
    return out.select("id", F.coalesce("employee_id", "linked_id").alias("employee_id"))


def orphans(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """Rows whose employee doesn't exist (a null reference is none): what a cascade would delete."""
    return rows.where("employee_id IS NOT NULL").join(employees.select(F.col("id").alias("employee_id")), "employee_id", "left_anti")
