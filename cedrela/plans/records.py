"""Searches with names and numbers, what a case file shows of a document, layouts of documents and turns of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import readings, repair
from ..operators import case_file, contracts, cv, dossier, layout, search
from ..views import key_sql, with_views
from . import Catalogue, people, whole

C = Catalogue()


@C.add(
    f"""{with_views('employees', 'contracts')} SELECT c.id FROM contracts c LEFT JOIN employees e ON e.id = c.employee_id
WHERE contains(lower(concat_ws(' ', e.full_name, c.worker_document_number, e.area, c.contract_type)), 'fijo')"""
)
def contract_search(spark: SparkSession, d: str) -> DataFrame:
    people = views.employees(spark, d).select(F.col("id").alias("employee_id"), F.col("full_name").alias("worker_name"), F.col("area").alias("position"))
    return search.contracts(views.contracts(spark, d).join(people, "employee_id", "left"), "FIJO").select("id")


@C.add("SELECT o_orderkey AS id FROM orders WHERE contains(lower(concat_ws(' ', 'pedido ' || o_orderkey, o_orderpriority, o_orderstatus)), '-high')")
def vacancy_search(spark: SparkSession, d: str) -> DataFrame:
    rows = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Pedido "), "o_orderkey").alias("title"), F.col("o_orderpriority").alias("department"), F.lit(None).cast("string").alias("location"), F.col("o_orderstatus").alias("status"))
    return search.vacancies(rows, " -High ").select("id")


@C.add(
    f"""{with_views('employees', 'contracts', 'settlements')} SELECT * FROM (SELECT s.id, coalesce(e.full_name, nullif(s.worker_document_number, ''), 'Sin identificar') AS person_name, s.worker_document_number AS n
  FROM settlements s LEFT JOIN employees e ON e.id = s.employee_id) SELECT_ WHERE contains(lower(person_name || ' ' || n), '0001')"""
)
def settlement_search(spark: SparkSession, d: str) -> DataFrame:
    rows = views.settlements(spark, d).withColumns({"worker_name": F.lit(None).cast("string"), "position": F.lit(None).cast("string")})
    return search.settlements(rows, views.employees(spark, d), "0001").select("id", "person_name", F.col("worker_document_number").alias("n"))


CATEGORY = {"de": "contrato", "en": "liquidacion", "es": "memorando", "fr": "llamado_atencion"}


@C.add(
    f"""{with_views('contracts', 'settlements', 'memoranda', 'employee_documents')}, d AS (SELECT id, employee_id, {key_sql('worker_document_number')} AS k, CASE category {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in CATEGORY.items())} END AS category FROM employee_documents),
c AS (SELECT {key_sql('worker_document_number')} AS k, min(id) AS id FROM contracts GROUP BY 1), s AS (SELECT {key_sql('worker_document_number')} AS k, min(id) AS id FROM settlements GROUP BY 1),
m AS (SELECT employee_id, id, row_number() OVER (PARTITION BY employee_id ORDER BY ts DESC, id DESC) AS nth FROM memoranda)
SELECT d.id AS document_id, 'contrato' AS kind, 1 AS nth, c.id AS record_id FROM d JOIN c ON c.k = d.k AND d.k != '' WHERE category = 'contrato'
UNION ALL SELECT d.id, 'liquidacion', 1, s.id FROM d JOIN s ON s.k = d.k AND d.k != '' WHERE category = 'liquidacion'
UNION ALL SELECT d.id, 'memo', m.nth, m.id FROM d JOIN m ON m.employee_id = d.employee_id WHERE m.nth <= 3 AND category IN ('memorando', 'llamado_atencion')"""
)
def document_details(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])
    documents = views.employee_documents(spark, d).withColumn("category", kinds[F.col("category")])
    return case_file.details(documents, views.contracts(spark, d), views.settlements(spark, d), views.memoranda(spark, d))


LINES = """line AS (SELECT l_orderkey AS doc_id, l_suppkey % 2 AS page, l_linenumber % 2 AS col, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_returnflag || l_partkey AS text, l_quantity AS font_size, CASE WHEN l_tax > 0 THEN l_discount END AS confidence FROM lineitem)"""


@C.add(
    f"""WITH {LINES}, p AS (SELECT doc_id, page, CASE WHEN max(col) > 0 THEN 2 ELSE 1 END AS columns FROM line GROUP BY ALL), q AS (SELECT doc_id, count(*) AS n_pages, string_agg(columns, ',' ORDER BY page) AS columns FROM p GROUP BY 1)
SELECT doc_id, n_lines, n_pages, columns, text, font_size, confidence FROM (SELECT doc_id, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY pos) AS text, median(font_size) AS font_size, round(avg(coalesce(confidence, 1)), 6) AS confidence FROM line GROUP BY 1) JOIN q USING (doc_id)"""
)
def layout_documents(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    pos = F.row_number().over(layout.Window.partitionBy("l_orderkey").orderBy(*order))
    lines = views.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).alias("page"), (F.col("l_linenumber") % 2).alias("col"), pos.alias("pos"), F.concat("l_returnflag", "l_partkey").alias("text"), F.col("l_quantity").alias("font_size"),
        F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("confidence"),
    )
    out = layout.document_layouts(lines.drop("confidence"), lines.select("doc_id", "page", "confidence"))
    return out.withColumns({"columns": F.array_join(F.transform("columns", lambda x: x.cast("string")), ","), "confidence": F.round("confidence", 6)})


#: Probes of pages: an order is a page, its items are probes.
PROBES = """probe AS (SELECT l_orderkey AS page_id, (l_linenumber - 1) % 4 * 90 AS turn, CAST(l_quantity AS INT) * 4 AS chars, CAST(l_partkey % 101 AS DOUBLE) AS confidence, l_suppkey % 7 AS width, l_suppkey % 5 AS height,
  row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % 4 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth FROM lineitem), one AS (SELECT *, CASE WHEN chars < 60 THEN 0 ELSE confidence END AS v FROM probe WHERE nth = 1)"""


@C.add(
    f"""WITH {PROBES}, u AS (SELECT page_id, v AS upright, chars >= 60 AS read, CASE WHEN height >= width THEN [0, 180] ELSE [0, 90, 270] END AS turns FROM one WHERE turn = 0),
b AS (SELECT o.page_id, upright, read, len(turns) AS n, turn, confidence, v, row_number() OVER (PARTITION BY o.page_id ORDER BY v DESC, turn) AS nth FROM one o JOIN u USING (page_id) WHERE list_contains(turns, turn))
SELECT page_id, CASE WHEN NOT (n = 2 AND read AND upright >= {readings.CLEAR}) AND v >= upright + {readings.MARGIN} AND confidence >= {readings.LEAST_SURE} THEN turn ELSE 0 END AS turn FROM b WHERE nth = 1"""
)
def page_orientations(spark: SparkSession, d: str) -> DataFrame:
    turn = ((F.col("l_linenumber") - 1) % 4 * 90).cast("int")
    nth = F.row_number().over(layout.Window.partitionBy("l_orderkey", turn).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    probes = views.read(spark, d, "lineitem").withColumn("nth", nth).where("nth = 1")
    probes = probes.select(F.col("l_orderkey").alias("page_id"), turn.alias("turn"), (F.col("l_quantity").cast("int") * 4).alias("chars"), (F.col("l_partkey") % 101).cast("double").alias("confidence"), (F.col("l_suppkey") % 7).alias("width"), (F.col("l_suppkey") % 5).alias("height"))
    return dossier.orientations(probes)


@C.add(
    """WITH s AS (SELECT p_partkey AS id, 100 + p_size * 60 AS w, 100 + p_retailprice AS h FROM part)
SELECT id, round(CASE WHEN w * h * (300 / 72.0) * (300 / 72.0) <= 4500000 THEN 300 / 72.0 ELSE greatest(1.5, sqrt(4500000 / (w * h))) END, 6)::DOUBLE AS render,
  round(greatest(0.25, CASE WHEN w * h * pow(greatest(1.0, 2400.0 / w), 2) > 12000000 THEN sqrt(12000000 / (w * h)) ELSE greatest(1.0, 2400.0 / w) END), 6)::DOUBLE AS working FROM s"""
)
def page_scales(spark: SparkSession, d: str) -> DataFrame:
    w, h = (100 + F.col("p_size") * 60).cast("double"), 100 + F.col("p_retailprice")
    return views.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(readings.render_scale(w, h), 6).alias("render"), F.round(readings.working_scale(w, h), 6).alias("working"))


@C.add()
def cv_record_documents(spark: SparkSession, d: str) -> DataFrame:
    """One record for each text; tests/test_cv.py has literal ones."""
    mine = spark.createDataFrame(list(people.CV.items()), "doc_id int, text string")
    out = cv.cvs(whole.texts(spark, d, mine))
    return out.withColumns({c: F.to_json(c) for c, kind in out.dtypes if kind.startswith("array")})


@C.add()
def contract_record_documents(spark: SparkSession, d: str) -> DataFrame:
    """One record for each text; tests/test_geometry.py has literal ones."""
    mine = spark.createDataFrame(list(people.CONTRACTS.items()), "doc_id int, text string")
    return contracts.contracts(whole.texts(spark, d, mine))


@C.add()
def rebuilt_email_documents(spark: SparkSession, d: str) -> DataFrame:
    """tests/test_experience.py holds the rule against plain Python."""
    return whole.listed(spark, d, people.EMAILS).select("id", repair.rebuilt_email(F.col("x"), strict=True).alias("email"))
