"""Alerts, status, history, case file, matching, search and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..config import DEFAULT
from ..operators import alerts, case_file, history, matching, reports, search
from ..views import key_sql, with_views
from . import Catalogue

C = Catalogue()
DAY = f"DATE '{DEFAULT.as_of}'"

CONTRACT_ALERTS = f"""alert AS (
  SELECT c.id AS contract_id, c.employee_id, CASE WHEN c.end_date < {DAY} THEN 'contrato_vencido' ELSE 'vencimiento_contrato' END AS alert_type, c.end_date AS due_date
  FROM contracts c JOIN employees e ON e.id = c.employee_id
  WHERE e.status = 'activo' AND c.status = 'vigente' AND c.end_date <= {DAY} + {DEFAULT.notice_days})"""


def contract_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.contract_alerts(views.employees(spark, d), views.contracts(spark, d), DEFAULT)


@C.add(f"{with_views('employees', 'contracts')}, {CONTRACT_ALERTS} SELECT alert_type, count(*) AS n_alerts, count(DISTINCT employee_id) AS n_employees FROM alert GROUP BY 1")
def alerts_contract_expiry(spark: SparkSession, d: str) -> DataFrame:
    return alerts.expiry_summary(contract_alerts(spark, d))


@C.add(f"{with_views('employees', 'contracts')}, {CONTRACT_ALERTS} SELECT * FROM alert")
def alerts_contract_rows(spark: SparkSession, d: str) -> DataFrame:
    return contract_alerts(spark, d)


@C.add(
    f"""{with_views('memoranda')}, r AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY ts, id) AS nth, count(*) OVER (PARTITION BY employee_id) AS n_memos FROM memoranda)
SELECT employee_id, n_memos, CAST(ts AS DATE) AS due_date FROM r WHERE nth = {DEFAULT.memo_threshold}"""
)
def alerts_memo_threshold(spark: SparkSession, d: str) -> DataFrame:
    return alerts.memo_alerts(views.memoranda(spark, d), DEFAULT)


@C.add(
    f"""{with_views('employees', 'contracts')}, h AS (SELECT employee_id, min(start_date) AS hire_date FROM contracts WHERE employee_id IS NOT NULL GROUP BY 1),
t AS (SELECT h.*, least(CAST(hire_date + INTERVAL {DEFAULT.trial_months} MONTH AS DATE), hire_date + {DEFAULT.max_trial_days}) AS trial_end FROM h JOIN employees e ON e.id = h.employee_id WHERE e.status = 'activo')
SELECT employee_id, hire_date, trial_end, trial_end - {DAY} AS days_left FROM t WHERE trial_end - {DAY} BETWEEN 0 AND {DEFAULT.notice_days}"""
)
def alerts_probation(spark: SparkSession, d: str) -> DataFrame:
    return alerts.probation_alerts(views.employees(spark, d), views.contracts(spark, d), DEFAULT)


def existing_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts on file: one for each contract with an employee, some of them resolved, and a memo alert for each employee."""
    c = views.contracts(spark, d).where("employee_id IS NOT NULL")
    kind = F.when(F.col("id") % 2 == 0, "contrato_vencido").otherwise("vencimiento_contrato")
    mine = c.select(F.col("id"), "employee_id", F.col("id").alias("contract_id"), kind.alias("alert_type"), F.when(F.col("id") % 9 == 0, "resuelta").otherwise("pendiente").alias("status"))
    e = views.employees(spark, d)
    memo = e.select((-F.col("id") - 1).alias("id"), (F.col("id") + F.when(F.col("id") % 100 == 0, 1_000_000_000).otherwise(0)).alias("employee_id"), F.lit(None).cast("long").alias("contract_id"), F.lit("memorandos").alias("alert_type"), F.lit("pendiente").alias("status"))
    return mine.union(memo)


EXISTING = """existing AS (
  SELECT id, employee_id, id AS contract_id, CASE WHEN id % 2 = 0 THEN 'contrato_vencido' ELSE 'vencimiento_contrato' END AS alert_type, CASE WHEN id % 9 = 0 THEN 'resuelta' ELSE 'pendiente' END AS status
  FROM contracts WHERE employee_id IS NOT NULL
  UNION ALL SELECT -id - 1, id + CASE WHEN id % 100 = 0 THEN 1000000000 ELSE 0 END, NULL, 'memorandos', 'pendiente' FROM employees)"""


@C.add(
    f"""{with_views('employees', 'contracts')}, {CONTRACT_ALERTS}, {EXISTING}
SELECT a.* FROM alert a WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.status != 'resuelta' AND x.alert_type = a.alert_type AND x.employee_id = a.employee_id AND x.contract_id = a.contract_id)"""
)
def alerts_new_only(spark: SparkSession, d: str) -> DataFrame:
    return alerts.new_alerts(contract_alerts(spark, d), existing_alerts(spark, d))


@C.add(
    f"""{with_views('employees', 'contracts', 'memoranda')}, {EXISTING}, m AS (SELECT employee_id, count(*) AS n_memos FROM memoranda GROUP BY 1)
SELECT * FROM (SELECT x.id AS alert_id, CASE WHEN e.status = 'inactivo' THEN 'empleado_inactivo' WHEN e.status IS NULL THEN NULL
    WHEN x.contract_id IS NOT NULL AND c.id IS NULL THEN 'contrato_no_vigente' WHEN x.alert_type = 'memorandos' AND coalesce(m.n_memos, 0) < {DEFAULT.memo_threshold} THEN 'memorandos_bajo_umbral' END AS reason
  FROM existing x LEFT JOIN employees e ON e.id = x.employee_id LEFT JOIN contracts c ON c.id = x.contract_id AND c.status = 'vigente' LEFT JOIN m ON m.employee_id = x.employee_id
  WHERE x.status != 'resuelta') WHERE reason IS NOT NULL"""
)
def alerts_stale(spark: SparkSession, d: str) -> DataFrame:
    n = views.memoranda(spark, d).groupBy("employee_id").agg(F.count("*").alias("n_memos"))
    return alerts.stale_alerts(existing_alerts(spark, d), views.employees(spark, d), views.contracts(spark, d), n, DEFAULT)


LINKED = f"""number AS (SELECT {key_sql('document_number')} AS k, min(id) AS id FROM employees GROUP BY 1)"""


def linked_sql(table: str, name: str, id_first: bool = True) -> str:
    other = "CASE WHEN t.employee_id IS NULL THEN n.id END" if id_first else "n.id"
    return f"""{name} AS (SELECT t.*, coalesce(e.id, {other}) AS linked_id FROM {table} t LEFT JOIN employees e ON e.id = t.employee_id LEFT JOIN number n ON n.k = {key_sql('t.worker_document_number')})"""


@C.add(
    f"""{with_views('employees', 'contracts', 'settlements')}, {LINKED}, {linked_sql('settlements', 's', False)}, {linked_sql('contracts', 'c')},
x AS (SELECT linked_id, max(exit_date) AS exit_on_file FROM s WHERE linked_id IS NOT NULL GROUP BY 1),
b AS (SELECT linked_id, max(start_date) AS last_start FROM c WHERE status != 'terminado' GROUP BY 1),
j AS (SELECT e.id AS employee_id, exit_on_file, e.status = 'inactivo' OR (exit_on_file IS NOT NULL AND NOT coalesce(last_start > exit_on_file, false)) AS gone
  FROM employees e LEFT JOIN x ON x.linked_id = e.id LEFT JOIN b ON b.linked_id = e.id)
SELECT employee_id, CASE WHEN gone THEN 'inactivo' ELSE 'activo' END AS status, CASE WHEN gone THEN exit_on_file END AS exit_date,
  CASE WHEN gone THEN CASE WHEN exit_on_file IS NOT NULL THEN 'liquidacion' ELSE 'sin_registrar' END END AS reason FROM j"""
)
def employment_status(spark: SparkSession, d: str) -> DataFrame:
    return history.employment_status(views.employees(spark, d), views.contracts(spark, d), views.settlements(spark, d))


@C.add(
    f"""{with_views('employees', 'contracts', 'memoranda', 'employee_documents')}, {LINKED}, {linked_sql('employee_documents', 'd')},
p AS (SELECT e.id AS employee_id, c.id, c.start_date, c.employee_id IS NULL OR c.employee_id != e.id AS by_document FROM employees e JOIN contracts c ON c.employee_id = e.id OR {key_sql('c.worker_document_number')} = {key_sql('e.document_number')})
SELECT e.id AS employee_id, coalesce(n_contracts, 0) AS n_contracts, coalesce(n_by_document, 0) AS n_by_document, first_start, coalesce(n_memos, 0) AS n_memos, coalesce(n_documents, 0) AS n_documents
FROM employees e LEFT JOIN (SELECT employee_id, count(*) AS n_contracts, count(*) FILTER (WHERE by_document) AS n_by_document, min(start_date) AS first_start FROM p GROUP BY 1) c ON c.employee_id = e.id
LEFT JOIN (SELECT employee_id, count(*) AS n_memos FROM memoranda GROUP BY 1) m ON m.employee_id = e.id LEFT JOIN (SELECT linked_id, count(*) AS n_documents FROM d GROUP BY 1) x ON x.linked_id = e.id"""
)
def person_history(spark: SparkSession, d: str) -> DataFrame:
    return history.person_history(views.employees(spark, d), views.contracts(spark, d), views.memoranda(spark, d), views.employee_documents(spark, d))


@C.add(
    f"""{with_views('contracts')} SELECT employee_id, id AS contract_id, contract_type FROM (SELECT *, row_number() OVER (PARTITION BY employee_id
  ORDER BY CASE WHEN status = 'vigente' THEN 0 ELSE 1 END, start_date DESC, id) AS nth FROM contracts WHERE employee_id IS NOT NULL) WHERE nth = 1"""
)
def current_role(spark: SparkSession, d: str) -> DataFrame:
    return history.current_role(views.contracts(spark, d))


def status_events(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "events").select(F.col("user_id").alias("employee_id"), F.col("event_id").alias("id"), "ts", "event_type")


@C.add(
    """SELECT user_id AS employee_id, event_id AS id, event_type, row_number() OVER w AS nth, date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS days_since
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def status_timeline(spark: SparkSession, d: str) -> DataFrame:
    return history.timeline(status_events(spark, d))


@C.add(f"{with_views('memoranda')} SELECT id, employee_id, count(*) OVER (PARTITION BY employee_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS memo_count FROM memoranda")
def memo_running_count(spark: SparkSession, d: str) -> DataFrame:
    return history.running_memos(views.memoranda(spark, d))


@C.add(f"{with_views('memoranda')} SELECT employee_id, place, id FROM (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY ts DESC, id DESC) AS place FROM memoranda) WHERE place <= 3")
def last_three_memos(spark: SparkSession, d: str) -> DataFrame:
    return history.last_memos(views.memoranda(spark, d))


@C.add(
    f"""{with_views('employees', 'contracts')}, {LINKED}, {linked_sql('contracts', 'c')} SELECT id, coalesce(employee_id, linked_id) AS employee_id FROM c"""
)
def contracts_linked(spark: SparkSession, d: str) -> DataFrame:
    return history.fill_links(views.contracts(spark, d), views.employees(spark, d))


@C.add(
    f"""{with_views('employees', 'contracts', 'settlements')}, {LINKED}, {linked_sql('settlements', 's')},
r AS (SELECT *, row_number() OVER (PARTITION BY employee_id IS NULL, {key_sql('worker_document_number')} ORDER BY id) AS nth FROM s)
SELECT id, coalesce(employee_id, CASE WHEN nth = 1 THEN linked_id END) AS employee_id FROM r"""
)
def settlements_linked_first(spark: SparkSession, d: str) -> DataFrame:
    return history.fill_links(views.settlements(spark, d), views.employees(spark, d), first_only=True)


@C.add(f"{with_views('employees', 'employee_documents')} SELECT id, employee_id FROM employee_documents d WHERE employee_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM employees e WHERE e.id = d.employee_id AND e.area != 'MACHINERY')")
def orphan_documents(spark: SparkSession, d: str) -> DataFrame:
    kept = views.employees(spark, d).where("area != 'MACHINERY'")  # those of one area are taken as deleted
    return history.orphans(views.employee_documents(spark, d), kept).select("id", "employee_id")


SECTIONS = f"""{with_views('employees', 'employee_documents')}, {LINKED}, {linked_sql('employee_documents', 'd')},
s AS (SELECT CASE WHEN d.linked_id IS NULL THEN 'anon:' || coalesce(worker_name, '') || '|' || coalesce(worker_document_number, '') ELSE 'emp:' || d.linked_id END AS section,
  CASE WHEN d.linked_id IS NULL THEN coalesce(worker_name, worker_document_number, 'Sin identificar') ELSE full_name END AS title, d.linked_id IS NULL AS anonymous, count(*) AS n_documents, max(d.id) AS last_id
  FROM d LEFT JOIN employees e ON e.id = d.linked_id GROUP BY 1, 2, 3)"""


@C.add(f"{SECTIONS} SELECT * FROM s")
def case_file_sections(spark: SparkSession, d: str) -> DataFrame:
    return case_file.sections(views.employee_documents(spark, d), views.employees(spark, d))


@C.add(f"{SECTIONS} SELECT section, title, n_documents FROM s ORDER BY anonymous, title, section LIMIT 6 OFFSET 12")
def case_file_page(spark: SparkSession, d: str) -> DataFrame:
    return case_file.page(case_file_sections(spark, d), 2, spanish=False).select("section", "title", "n_documents")


@C.add(f"{with_views('employees', 'employee_documents')}, {LINKED}, {linked_sql('employee_documents', 'd')} SELECT id, worker_name FROM d WHERE linked_id IS NULL")
def case_file_unlinked(spark: SparkSession, d: str) -> DataFrame:
    return case_file.filtered(views.employee_documents(spark, d), views.employees(spark, d)).select("id", "worker_name")


#: Fixed requirements of three vacancies; blank and weightless ones included.
REQUIREMENTS = [(1, "Ríng", 5, "habilidad"), (1, "red", 3, "habilidad"), (1, "ECONOMY", 2, "educacion"), (1, " ", 9, "habilidad"), (2, "small", 0, "experiencia"), (2, "brand#1", 4, "experiencia"), (2, "standard", 1, "otro"), (3, "anvil", None, "habilidad"), (3, "brand#2", 2, "raro")]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("skills"), F.col("p_brand").alias("headline"), F.col("p_type").alias("education"), F.lit("").alias("city"))


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, "vacancy_id int, skill_or_req string, weight int, req_type string")


_VALUES = ", ".join(f"({v}, '{t}', {'NULL' if w is None else w}, '{k}')" for v, t, w, k in REQUIREMENTS)
SCORES = f"""r AS (SELECT vacancy_id, strip_accents(lower(trim(t))) AS term, greatest(coalesce(w, 1), 1) AS weight, k FROM (VALUES {_VALUES}) v(vacancy_id, t, w, k) WHERE trim(t) != ''),
p AS (SELECT p_partkey AS candidate_id, lower(p_name) AS skills, lower(p_brand) AS headline, lower(p_type) AS education FROM part),
m AS (SELECT candidate_id, vacancy_id, weight, contains(CASE k WHEN 'habilidad' THEN skills WHEN 'experiencia' THEN headline || ' ' || skills WHEN 'educacion' THEN education ELSE skills || ' ' || headline || ' ' || education || ' ' END, term) AS met FROM p, r),
score AS (SELECT candidate_id, vacancy_id, round(1000.0 * coalesce(sum(weight) FILTER (WHERE met), 0) / sum(weight)) / 10 AS score, count(*) FILTER (WHERE met) AS n_matched FROM m GROUP BY 1, 2)"""


@C.add(f"WITH {SCORES} SELECT * FROM score")
def match_scores(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_scores(candidates(spark, d), requirements(spark))


@C.add(f"WITH {SCORES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY score DESC, candidate_id) AS place FROM score) WHERE place <= 10")
def match_top10(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_matches(candidates(spark, d), requirements(spark))


@C.add(f"""{with_views('employees')} SELECT facet, value, count(*) AS n FROM (SELECT 'area' AS facet, area AS value FROM employees UNION ALL SELECT 'city', city FROM employees UNION ALL SELECT 'status', status FROM employees) WHERE length(value) > 1 GROUP BY 1, 2""")
def candidate_facets(spark: SparkSession, d: str) -> DataFrame:
    return search.facet_values(views.employees(spark, d), ["area", "city", "status"])


@C.add(f"""{with_views('employees')} SELECT id, full_name FROM employees WHERE contains(lower(concat_ws(' ', full_name, document_number, city)), 'nation_1') AND area = 'BUILDING' AND status = 'activo'""")
def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    facets = {"area": "BUILDING", "status": "activo", "city": search.ALL}
    return search.faceted(views.employees(spark, d), " Nation_1 ", ["full_name", "document_number", "city"], facets).select("id", "full_name")


@C.add(f"""{with_views('contracts')} SELECT id, contract_type, status FROM contracts WHERE contains(lower(concat_ws(' ', worker_document_number, contract_type, status)), '01-obra'.replace('-obra', '')) AND contains(lower(concat_ws(' ', worker_document_number, contract_type, status)), 'obra')""")
def free_text_search(spark: SparkSession, d: str) -> DataFrame:
    columns = ["worker_document_number", "contract_type", "status"]
    found = search.faceted(views.contracts(spark, d), "OBRA", columns, {})
    return found.where(search.mentions("01", *columns)).select("id", "contract_type", "status")


@C.add(
    f"""{with_views('employees', 'contracts')}, {EXISTING} SELECT 'empleados' AS metric, count(*) AS value FROM employees UNION ALL SELECT 'empleados_activos', count(*) FROM employees WHERE status = 'activo'
UNION ALL SELECT 'contratos_vigentes', count(*) FROM contracts WHERE status = 'vigente' UNION ALL SELECT 'alertas_pendientes', count(*) FROM existing WHERE status != 'resuelta'"""
)
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.dashboard(views.employees(spark, d), views.contracts(spark, d), existing_alerts(spark, d))


DOMAIN = ["vigente", "prorroga", "terminado", "renovado", "anulado"]


@C.add(
    f"""{with_views('contracts')} SELECT position, value, coalesce(n, 0) AS n FROM (VALUES {', '.join(f"({i}, '{v}')" for i, v in enumerate(DOMAIN))}) d(position, value) LEFT JOIN (SELECT status, count(*) AS n FROM contracts GROUP BY 1) c ON c.status = d.value"""
)
def status_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.domain_counts(views.contracts(spark, d), "status", DOMAIN)


@C.add(f"{with_views('contracts')} SELECT replace(contract_type, '_', ' ') AS contract_type, count(*) AS n FROM contracts GROUP BY 1")
def contract_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.type_counts(views.contracts(spark, d))


@C.add(f"{with_views('employees')} SELECT id AS codigo, coalesce(full_name, '') AS nombre, coalesce(document_number, '') AS documento, coalesce(area, '') AS area, coalesce(city, '') AS ciudad, coalesce(status, '') AS estado FROM employees")
def export_employees(spark: SparkSession, d: str) -> DataFrame:
    return reports.employee_sheet(views.employees(spark, d))


@C.add(f"{with_views('contracts')} SELECT id AS codigo, replace(contract_type, '_', ' ') AS tipo, strftime(start_date, '%Y-%m-%d') AS inicio, coalesce(strftime(end_date, '%Y-%m-%d'), 'Indefinido') AS fin, salary, status FROM contracts")
def export_contracts(spark: SparkSession, d: str) -> DataFrame:
    return reports.contract_sheet(views.contracts(spark, d))


@C.add("SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR, '; ' ORDER BY l_linenumber, l_partkey::VARCHAR) AS items FROM lineitem GROUP BY 1")
def export_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reports.nested_sheet(views.read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber")


RENEWALS = f"""{with_views('contracts')}, x AS (SELECT l_orderkey AS contract_id, l_linenumber AS seq, l_partkey AS tie, 1 + l_linenumber % 6 AS months, l_extendedprice FROM lineitem),
n AS (SELECT *, row_number() OVER w AS renewal_number, CAST(sum(months) OVER (w ROWS UNBOUNDED PRECEDING) AS INT) AS total FROM x WINDOW w AS (PARTITION BY contract_id ORDER BY seq, tie, l_extendedprice))"""


@C.add(f"{RENEWALS} SELECT contract_id, renewal_number, months, CAST(end_date + to_months(total) AS DATE) AS new_end FROM n JOIN contracts c ON c.id = n.contract_id WHERE end_date IS NOT NULL")
def renewal_sequence(spark: SparkSession, d: str) -> DataFrame:
    lines = views.read(spark, d, "lineitem")
    extensions = lines.select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("seq"), F.struct("l_partkey", "l_extendedprice").alias("tie"), (1 + F.col("l_linenumber") % 6).alias("months"))
    return reports.renewals(views.contracts(spark, d), extensions)


@C.add(
    """WITH s AS (SELECT l_orderkey AS id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS computed FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END AS total FROM orders)
SELECT t.id, CAST(coalesce(computed, 0) AS DOUBLE) AS computed, total, coalesce(total > 0 AND abs(computed::DOUBLE - total) > 1, false) AS inconsistent FROM t LEFT JOIN s USING (id)"""
)
def settlement_total_check(spark: SparkSession, d: str) -> DataFrame:
    concepts = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    stated = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("total"))
    return reports.settlement_check(concepts, stated)


@C.add(f"""{with_views('employees')} SELECT 'rrhh' AS role, count(*) AS n, count(balance) AS n_amounts FROM employees UNION ALL SELECT 'consulta', count(*), 0 FROM employees WHERE status = 'activo' UNION ALL SELECT 'otro', 0, 0""")
def rls_view_by_role(spark: SparkSession, d: str) -> DataFrame:
    e = views.employees(spark, d)
    parts = [reports.visible_to(e, role).agg(F.lit(role).alias("role"), F.count("*").alias("n"), F.count("balance").alias("n_amounts")) for role in ("rrhh", "consulta", "otro")]
    return parts[0].union(parts[1]).union(parts[2])


@C.add(f"""{with_views('employees', 'contracts')} SELECT count(*) AS n_invalid FROM employees WHERE status = 'inactivo' AND NOT regexp_full_match({key_sql('document_number')}, '[0-9]{{5,11}}') OR balance < -900""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    e = views.employees(spark, d)
    bad = (F.col("status") == "inactivo") & ~views.document_key(F.col("document_number")).rlike("^[0-9]{5,11}$")
    return e.where(bad | (F.col("balance") < -900)).agg(F.count("*").alias("n_invalid"))
