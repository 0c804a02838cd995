"""The personnel relations as projections of the supplied tables, for Spark and, as SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_key(number: Column) -> Column:
    """A document number without dots, blanks and hyphens: the one form that joins use."""
    return F.regexp_replace(number, r"[.\s-]", "")


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    digits = (F.col("c_custkey") + 10_000_000).cast("string")
    dotted = F.concat_ws(".", F.substring(digits, 1, 2), F.substring(digits, 3, 3), F.substring(digits, 6, 3))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("full_name"),
        F.col("c_mktsegment").alias("area"),
        F.when(F.col("c_acctbal") < 0, "inactivo").otherwise("activo").alias("status"),
        F.col("n_name").alias("city"),
        F.when(F.col("c_custkey") % 2 == 0, dotted).otherwise(digits).alias("document_number"),
        F.col("c_acctbal").alias("balance"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    kind = {"1-URGENT": "obra_labor", "2-HIGH": "termino_fijo", "3-MEDIUM": "termino_fijo", "4-NOT SPECIFIED": "prestacion_servicios", "5-LOW": "termino_indefinido"}
    status = {"F": "terminado", "O": "vigente", "P": "prorroga"}
    named = lambda values, key: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(key)]
    digits = (F.col("o_custkey") + 10_000_000).cast("string")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("employee_id"),
        F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 4)).alias("worker_document_number"),
        F.col("o_totalprice").alias("salary"),
        start.alias("start_date"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.add_months(start, 12)).alias("end_date"),
        named(status, "o_orderstatus").alias("status"),
        named(kind, "o_orderpriority").alias("contract_type"),
    )


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contracts(spark, sf_dir).where("status = 'terminado'")
    return done.select("id", "employee_id", "worker_document_number", F.date_add("start_date", 200).alias("exit_date"), F.col("salary").alias("base_salary"))


def event_key() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def memoranda(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "events").where((F.col("event_type") == "error") & (event_key() < 20))
    return found.select(F.col("event_id").alias("id"), F.col("user_id").alias("employee_id"), "ts", event_key().alias("k"))


def employee_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = (F.col("doc_id") % 97 + 10_000_000).cast("string")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 89).alias("employee_id"),
        F.when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", F.substring(digits, 1, 2), F.substring(digits, 3, 6))).alias("worker_document_number"),
        F.concat("lang", F.lit("/"), "source").alias("worker_name"),
        F.col("lang").alias("category"),
        F.col("n_chars").alias("size"),
    )


#: The same relations for DuckDB: CTEs, to be put before a query.
SQL = {
    "employees": """employees AS (
  SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS area, CASE WHEN c_acctbal < 0 THEN 'inactivo' ELSE 'activo' END AS status, n_name AS city,
    CASE WHEN c_custkey % 2 = 0 THEN substr(d, 1, 2) || '.' || substr(d, 3, 3) || '.' || substr(d, 6, 3) ELSE d END AS document_number, c_acctbal AS balance
  FROM (SELECT *, CAST(c_custkey + 10000000 AS VARCHAR) AS d FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey)""",
    "contracts": """contracts AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 != 0 THEN o_custkey END AS employee_id, substr(d, 1, 4) || '-' || substr(d, 5, 4) AS worker_document_number, o_totalprice AS salary,
    CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderpriority != '5-LOW' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) END AS end_date,
    CASE o_orderstatus WHEN 'F' THEN 'terminado' WHEN 'O' THEN 'vigente' WHEN 'P' THEN 'prorroga' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'obra_labor' WHEN '4-NOT SPECIFIED' THEN 'prestacion_servicios' WHEN '5-LOW' THEN 'termino_indefinido' ELSE 'termino_fijo' END AS contract_type
  FROM (SELECT *, CAST(o_custkey + 10000000 AS VARCHAR) AS d FROM orders))""",
    "settlements": """settlements AS (
  SELECT id, employee_id, worker_document_number, start_date + 200 AS exit_date, salary AS base_salary FROM contracts WHERE status = 'terminado')""",
    "memoranda": """memoranda AS (
  SELECT event_id AS id, user_id AS employee_id, ts, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
  WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS INT) < 20)""",
    "employee_documents": """employee_documents AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 89 END AS employee_id, CASE WHEN doc_id % 3 = 1 THEN substr(d, 1, 2) || ' ' || substr(d, 3, 6) END AS worker_document_number,
    lang || '/' || source AS worker_name, lang AS category, n_chars AS size FROM (SELECT *, CAST(doc_id % 97 + 10000000 AS VARCHAR) AS d FROM documents))""",
}


def with_views(*names: str) -> str:
    """`WITH` and these relations; settlements need contracts before them."""
    return "WITH " + ",\n".join(SQL[n] for n in names)


def key_sql(column: str) -> str:
    return f"regexp_replace({column}, '[.\\s-]', '', 'g')"
