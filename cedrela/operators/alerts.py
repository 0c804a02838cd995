"""Alert rules. Every rule takes the day it is evaluated for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def contract_alerts(employees: DataFrame, contracts: DataFrame, settings: Settings) -> DataFrame:
    """contract_id, employee_id, alert_type, due_date: contracts in force of active employees that have ended
    (contrato_vencido) or end within the notice period (vencimiento_contrato)."""
    day = F.lit(settings.as_of)
    active = employees.where("status = 'activo'").select(F.col("id").alias("employee_id"))
    due = contracts.where((F.col("status") == "vigente") & (F.col("end_date") <= F.date_add(day, settings.notice_days)))
    kind = F.when(F.col("end_date") < day, "contrato_vencido").otherwise("vencimiento_contrato")
    return due.join(active, "employee_id").select(F.col("id").alias("contract_id"), "employee_id", kind.alias("alert_type"), F.col("end_date").alias("due_date"))


def expiry_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count("*").alias("n_alerts"), F.countDistinct("employee_id").alias("n_employees"))


def memo_alerts(memoranda: DataFrame, settings: Settings) -> DataFrame:
    """employee_id, n_memos, due_date: the day on which an employee's memos reach the threshold. One alert for each employee,
    at exactly the threshold; later memos raise no more."""
    nth = F.row_number().over(Window.partitionBy("employee_id").orderBy("ts", "id"))
    total = memoranda.groupBy("employee_id").agg(F.count("*").alias("n_memos"))
    reached = memoranda.withColumn("nth", nth).where(F.col("nth") == settings.memo_threshold)
    return reached.join(total, "employee_id").select("employee_id", "n_memos", F.to_date("ts").alias("due_date"))


def probation_alerts(employees: DataFrame, contracts: DataFrame, settings: Settings) -> DataFrame:
    """employee_id, hire_date, trial_end, days_left: active employees whose trial ends within the notice period.

    The first contract is the hire; the trial is trial_months, max_trial_days at most. A trial that is over raises nothing.
    """
    hired = contracts.where("employee_id IS NOT NULL").groupBy("employee_id").agg(F.min("start_date").alias("hire_date"))
    end = F.least(F.add_months("hire_date", settings.trial_months), F.date_add("hire_date", settings.max_trial_days))
    left = F.date_diff("trial_end", F.lit(settings.as_of))
    active = employees.where("status = 'activo'").select(F.col("id").alias("employee_id"))
    return hired.join(active, "employee_id").withColumn("trial_end", end).withColumn("days_left", left).where(F.col("days_left").between(0, settings.notice_days))


def new_alerts(alerts: DataFrame, existing: DataFrame) -> DataFrame:
    """Alerts of which none of the same type, employee and contract is open. A resolved one doesn't block a new one: the
    condition holds again."""
    return alerts.join(existing.where("status != 'resuelta'"), ["alert_type", "employee_id", "contract_id"], "left_anti")


def stale_alerts(alerts: DataFrame, employees: DataFrame, contracts: DataFrame, memo_counts: DataFrame, settings: Settings) -> DataFrame:
    """alert_id, reason: open alerts to resolve: the employee is inactive, the contract is no longer in force, or the memos
    are below the threshold. An alert of an unknown employee stays."""
    people = employees.select(F.col("id").alias("employee_id"), F.col("status").alias("employee_status"))
    valid = contracts.where("status = 'vigente'").select(F.col("id").alias("contract_id"), F.lit(True).alias("in_force"))
    open_ = alerts.where("status != 'resuelta'").join(people, "employee_id", "left").join(valid, "contract_id", "left").join(memo_counts, "employee_id", "left")
    few = (F.col("alert_type") == "memorandos") & (F.coalesce("n_memos", F.lit(0)) < settings.memo_threshold)
    reason = (
        F.when(F.col("employee_status") == "inactivo", "empleado_inactivo")
        .when(F.col("employee_status").isNull(), None)
        .when(F.col("contract_id").isNotNull() & F.col("in_force").isNull(), "contrato_no_vigente")
        .when(few, "memorandos_bajo_umbral")
    )
    return open_.select(F.col("id").alias("alert_id"), reason.alias("reason")).where("reason IS NOT NULL")
