"""Facets and searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dictionaries import job_family

ALL = "todos"


def mentions(query: str, *columns: str) -> Column:
    """Some of the columns, joined by blanks, have the query in them; case doesn't count and a missing value is empty."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower()))


def faceted(rows: DataFrame, query: str, columns: Sequence[str], facets: Mapping[str, str], array_facets: Mapping[str, str] | None = None) -> DataFrame:
    """Rows that mention the query and have every facet's value (ALL: any); of an array, one element is enough."""
    out = rows.where(mentions(query, *columns)) if query.strip() else rows
    for name, value in facets.items():
        out = out if value == ALL else out.where(F.col(name) == value)
    for name, value in (array_facets or {}).items():
        out = out if value == ALL else out.where(F.array_contains(name, value))
    return out


def active_filters(query: str, facets: Mapping[str, str]) -> int:
    return sum(v != ALL for v in facets.values()) + bool(query.strip())


def facet_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n: what each facet can be set to: values of two characters or more."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(each.alias("x")).select("x.*").where(F.length("value") > 1).groupBy("facet", "value").agg(F.count("*").alias("n"))


def city_of(place: Column) -> Column:
    return F.trim(F.split_part(place, F.lit(","), F.lit(1)))


def in_locale_order(values: DataFrame, within: Sequence[str], column: str, locale: str = "es") -> DataFrame:
    """values with nth (from 1): their place within each group in the order of a locale, not of code points: accents and case
    count only where letters are the same, ñ comes after n; values equal there go by code points."""
    order = Window.partitionBy(*within).orderBy(F.collate(column, locale), column)
    return values.withColumn("nth", F.row_number().over(order).cast("long"))


def job_facet(rows: DataFrame, job: str = "job", headline: str = "headline") -> DataFrame:
    """facet, value, n of the derived facet: the family of the latest job (else of the headline), or what it says if it is of
    no known family; as facet_values() has it."""
    said = F.coalesce(F.nullif(F.trim(job), F.lit("")), F.nullif(F.trim(headline), F.lit("")))
    return facet_values(rows.select(F.coalesce(job_family(said), said).alias("job")), ["job"])


def contracts(rows: DataFrame, query: str) -> DataFrame:
    """Contracts that mention the query in the worker's name or number, the position, or the type."""
    return rows.where(mentions(query, "worker_name", "worker_document_number", "position", "contract_type"))


def vacancies(rows: DataFrame, query: str) -> DataFrame:
    """Vacancies that mention the query in title, department, location or status; missing ones are empty."""
    return rows.where(mentions(query, "title", "department", "location", "status"))


def named_settlements(rows: DataFrame, employees: DataFrame) -> DataFrame:
    """Settlements with person_name: the employee's by id, else the one that was read, else the number, else `Sin identificar`."""
    names = employees.select(F.col("id").alias("employee_id"), F.col("full_name").alias("_name"))
    person = F.coalesce("_name", F.nullif("worker_name", F.lit("")), F.nullif("worker_document_number", F.lit("")), F.lit("Sin identificar"))
    return rows.join(names, "employee_id", "left").withColumn("person_name", person).drop("_name")


def settlements(rows: DataFrame, employees: DataFrame, query: str) -> DataFrame:
    """Settlements (named) that mention the query in the person's name, the number or the position, whatever the case."""
    return named_settlements(rows, employees).where(mentions(query, "person_name", "worker_document_number", "position"))
