"""Dashboard counts, exported sheets, renewals and settlement checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dashboard(employees: DataFrame, contracts: DataFrame, alerts: DataFrame) -> DataFrame:
    """metric, value: the counters of the first page, one pass over each table."""
    e = employees.agg(F.count("*").alias("empleados"), F.count_if(F.col("status") == "activo").alias("empleados_activos"))
    c = contracts.agg(F.count_if(F.col("status") == "vigente").alias("contratos_vigentes"))
    a = alerts.agg(F.count_if(F.col("status") != "resuelta").alias("alertas_pendientes"))
    long = lambda df: df.unpivot([], df.columns, "metric", "value")
    return long(e).union(long(c)).union(long(a))


def domain_counts(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """position, value, n for a fixed list of values, zeros included; other values are left out."""
    wanted = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], "position int, value string")
    n = rows.where(F.col(column).isin(*domain)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return wanted.join(n, "value", "left").select("position", "value", F.coalesce("n", F.lit(0)).alias("n"))


def type_counts(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy(F.replace("contract_type", F.lit("_"), F.lit(" ")).alias("contract_type")).agg(F.count("*").alias("n"))


def employee_sheet(employees: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return employees.select(F.col("id").alias("codigo"), text("full_name").alias("nombre"), text("document_number").alias("documento"), text("area").alias("area"), text("city").alias("ciudad"), text("status").alias("estado"))


def contract_sheet(contracts: DataFrame) -> DataFrame:
    end = F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("Indefinido"))
    return contracts.select(F.col("id").alias("codigo"), F.replace("contract_type", F.lit("_"), F.lit(" ")).alias("tipo"), F.date_format("start_date", "yyyy-MM-dd").alias("inicio"), end.alias("fin"), "salary", "status")


def nested_sheet(rows: DataFrame, key: str, item: str, order: str, sep: str = "; ") -> DataFrame:
    """key, n, items: lists as one text, in order: how nested lists are written to a flat sheet."""
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("v"))))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(got, lambda x: x["v"]), sep).alias("items"))


def renewals(contracts: DataFrame, extensions: DataFrame) -> DataFrame:
    """contract_id, renewal_number, months, new_end: each renewal adds to the end before it.

    Months are added to the first end at once, so a short month on the way doesn't shorten the later ones.
    """
    w = Window.partitionBy("contract_id").orderBy("seq", "tie")
    numbered = extensions.withColumn("renewal_number", F.row_number().over(w)).withColumn("total", F.sum("months").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = contracts.where("end_date IS NOT NULL").select(F.col("id").alias("contract_id"), "end_date")
    return numbered.join(ends, "contract_id").select("contract_id", "renewal_number", "months", F.add_months("end_date", F.col("total").cast("int")).alias("new_end"))


def settlement_check(concepts: DataFrame, stated: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """id, computed, total, inconsistent: the concepts' sum against a stated total over 0."""
    sums = concepts.groupBy("id").agg(F.sum(F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))).alias("computed"))
    off = (F.col("total") > 0) & (F.abs(F.col("computed") - F.col("total")) > tolerance)
    return stated.join(sums, "id", "left").select("id", F.coalesce("computed", F.lit(0)).cast("double").alias("computed"), "total", F.coalesce(off, F.lit(False)).alias("inconsistent"))


def visible_to(rows: DataFrame, role: str) -> DataFrame:
    """What a role sees of the employees: admin and rrhh all, reclutador and consulta active people without amounts, others
    nothing. A view for reports; access itself belongs to the catalog."""
    if role in ("admin", "rrhh"):
        return rows
    shown = rows.where("status = 'activo'") if role in ("reclutador", "consulta") else rows.where("false")
    return shown.withColumn("balance", F.lit(None).cast("double"))
