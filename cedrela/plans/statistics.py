"""Order statistics over all line items, values in the order of a locale, and records of many types in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.text import fold
from ..operators import order_statistics as ranks
from ..operators import reparse, search
from . import Catalogue, documents, whole
from .fields import FOLD

C = Catalogue()


@C.add(
    """WITH p AS (SELECT l_returnflag, l_discount AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_discount > 0),
u AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, (max(v) FILTER (WHERE k = (n - 1) // 2) + max(v) FILTER (WHERE k = n // 2)) / 2 AS median_discount, any_value(upper_price) AS upper_price, any_value(spread_price) AS spread_price
FROM p JOIN (SELECT l_returnflag, max(v) FILTER (WHERE k = n // 2) AS upper_price, max(v) FILTER (WHERE k = floor(0.98::DOUBLE * (n - 1))) - max(v) FILTER (WHERE k = floor(0.02::DOUBLE * (n - 1))) AS spread_price FROM u GROUP BY 1) USING (l_returnflag) GROUP BY 1"""
)
def price_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Three groups hold all rows, so each is a hot one."""
    rows = views.read(spark, d, "lineitem")
    by = "l_returnflag"
    discount = ranks.median_of_positives(rows, by, "l_discount").withColumnRenamed("median", "median_discount")
    price = ranks.upper_median(rows, by, "l_extendedprice").withColumnRenamed("median", "upper_price")
    return discount.join(price, by).join(ranks.spread(rows, by, "l_extendedprice").withColumnRenamed("spread", "spread_price"), by)


@C.add(
    """WITH q AS (SELECT l_suppkey, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(v) FILTER (WHERE k = n // 2) AS median FROM q GROUP BY 1"""
)
def quantity_medians(spark: SparkSession, d: str) -> DataFrame:
    return ranks.upper_median(views.read(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@C.add(
    f"""WITH w AS (SELECT DISTINCT lang AS facet, unnest(string_split_regex(lower(text), '[^a-zñáéíóúüäößàâçèêëîïôùû]+')) AS value FROM documents)
SELECT facet, value, row_number() OVER (PARTITION BY facet, substr({FOLD.format('value')}, 1, 1) ORDER BY value COLLATE es, value) AS nth FROM w WHERE length(value) > 3"""
)
def facet_order_documents(spark: SparkSession, d: str) -> DataFrame:
    """The words of each language in Spanish order, numbered by their first letter."""
    words = F.explode(F.split(F.lower("text"), "[^a-zñáéíóúüäößàâçèêëîïôùû]+"))
    values = views.read(spark, d, "documents").select(F.col("lang").alias("facet"), words.alias("value")).where(F.length("value") > 3).distinct()
    return search.in_locale_order(values.withColumn("letter", fold(F.col("value")).substr(1, 1)), ["facet", "letter"], "value").drop("letter")


#: What is taken out of each kind's record, and the query whose SQL parses that kind.
SHOWN = {"cedula": ("parse_id_card", "document_number"), "salud": ("parse_health", "worker_name"), "liquidacion": ("parse_settlement", "employer_name"), "memorando": ("parse_memo", "subject"), "llamado_atencion": ("parse_memo", "subject"), "funciones": ("parse_functions", "position")}
PARSED = " UNION ALL ".join(f"SELECT c.doc_id, c.category, CAST(p.{field} AS VARCHAR) AS shown FROM class c JOIN ({whole.C.sql[f'{query}_documents']}) p ON p.doc_id = c.doc_id WHERE c.category = '{kind}'" for kind, (query, field) in SHOWN.items())


@C.add(f"WITH folded AS (SELECT doc_id, {documents.fold_only('text')} AS x FROM {whole.ALL_TEXTS}), {documents.CLASSES} {PARSED}")
def reparsed_documents(spark: SparkSession, d: str) -> DataFrame:
    found = reparse.reparsed(whole.texts(spark, d))
    shown = F.coalesce(*[F.when(F.col("category") == kind, F.try_variant_get("record", f"$.{field}", "string")) for kind, (_, field) in SHOWN.items()])
    return found.select("doc_id", "category", shown.alias("shown"))
