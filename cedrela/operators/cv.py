"""One record of a CV: each field by its label, else by context, else by its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, repair, shapes
from ..functions.text import fold, held, holds_any, strip_bullets
from . import experience, geometry, labels, lines, people
from .persons import written

# Labels of a CV's fields.
LABELS = {
    "full_name": ["nombres y apellidos", "nombre completo", "nombre y apellidos"],
    "birth_date": ["fecha de nacimiento", "fecha nacimiento", "nacimiento"],
    "birth_place": ["lugar de nacimiento", "ciudad de nacimiento"],
    "nationality": ["nacionalidad", "pais"],
    "marital_status": ["estado civil"],
    "gender": ["genero", "sexo"],
    "address": ["direccion", "direccion de residencia", "domicilio"],
    "driver_license": ["licencia de conduccion", "licencia de conducir", "licencia"],
    "military_card": ["libreta militar"],
    "professional_card": ["tarjeta profesional", "matricula profesional"],
    "availability": ["disponibilidad"],
    "salary": ["aspiracion salarial", "salario", "salario esperado", "expectativa salarial"],
}
HEADLINE_LABELS = ["titular", "cargo al que aspira", "cargo aspirado", "cargo", "cargo actual", "objetivo", "objetivo profesional", "puesto", "ocupacion"]
#: Lines under the name in which a headline is looked for.
UNDER_NAME = 3
SOCIAL = r"(?i)(?:https?://)?(?:www\.)?(?:linkedin\.com/in|github\.com)/[a-z0-9_-]+"
DAY = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _short(value: Column) -> Column:
    """What stands before a bar."""
    return F.nullif(F.trim(F.substring_index(value, "|", 1)), F.lit(""))


def labelled(rows: DataFrame) -> DataFrame:
    """doc_id and the fields of LABELS by their labels, each cut to what it can be."""
    pay = lambda v: shapes.pay_in(F.concat(F.lit("pago: "), v))
    card = lambda v: F.nullif(F.regexp_extract(v, r"(?i)\b([a-z0-9][a-z0-9-]{3,20})", 1), F.lit(""))
    licence = lambda v: F.nullif(F.upper(F.regexp_extract(v, r"(?i)\b(a1|a2|b1|b2|b3|c1|c2|c3)\b", 1)), F.lit(""))
    born = lambda v: F.nullif(F.regexp_extract(v, DAY, 0), F.lit(""))
    valid = {"birth_date": lambda v: born(v).isNotNull(), "salary": lambda v: pay(v).isNotNull(), "driver_license": lambda v: licence(v).isNotNull(), "professional_card": lambda v: card(v).isNotNull(), "full_name": names.looks_like_name}
    found = labels.labelled_fields(labels.candidates(rows.withColumn("scope", F.lit(None).cast("string"))), LABELS, valid=valid)
    cut = {"birth_date": born, "salary": pay, "driver_license": licence, "professional_card": card, "nationality": lambda v: _short(F.substring_index(v, ",", 1))}
    return found.select("doc_id", *[cut.get(c, _short)(F.col(c)).alias(c) for c in LABELS])


def headlines(head: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, headline out of the header's lines (doc_id, pos, text): by label; else the first of the three lines under the
    name that can be one; else the first line with a job; else the line after a label.

    known: doc_id, name (the text of the name's line, or the name), city, which is no headline.
    """
    city = F.col("city")
    ends = lambda x: F.trim(F.regexp_replace(x, r"[.;]\s*$", ""))
    fits = lambda v: (F.length(v) > 3) & shapes.may_be_headline(v, F.lit(None).cast("string"))
    said = labels.candidates(head.select("doc_id", "pos", "text", F.lit(None).cast("string").alias("scope")))
    # Pairs and lines with a label alone are looked at apart, each as a document of its own.
    apart = labels.labelled_fields(said.withColumn("doc_id", F.struct("doc_id", "alone")), {"h": HEADLINE_LABELS}, valid={"h": fits})
    by = lambda alone: F.max(F.when(F.col("doc_id.alone") == alone, ends(F.col("h"))))
    labelled_ = apart.groupBy(F.col("doc_id.doc_id").alias("id")).agg(by(False).alias("by_label"), by(True).alias("by_next")).withColumnRenamed("id", "doc_id")
    in_order = Window.partitionBy("doc_id").orderBy("pos")
    rows = head.withColumn("nth", F.row_number().over(in_order)).join(known.withColumn("name_folded", fold(F.col("name"))), "doc_id", "left")
    rows = held(rows, x=strip_bullets(F.col("text")), own=F.coalesce(F.contains(fold(F.col("text")), F.col("name_folded")), F.lit(False)))
    at = F.min(F.when(F.col("own"), F.col("nth"))).over(Window.partitionBy("doc_id"))
    open_ = held(rows.withColumn("at", at).where(~F.col("own") & shapes.may_be_headline_by_place(F.col("x"), city)), job=shapes.has_job(F.col("x")))
    job = F.col("job")
    under = F.col("nth").between(F.col("at") + 1, F.col("at") + UNDER_NAME) & (job | ~names.looks_like_name(F.col("x")) | (F.size(F.split(F.col("x"), r"\s+")) > 1))
    found = open_.groupBy("doc_id").agg(F.min_by("x", F.when(under, F.col("pos"))).alias("under"), F.min_by("x", F.when(job, F.col("pos"))).alias("by_job"))
    out = labelled_.join(found, "doc_id", "full")
    return out.select("doc_id", F.coalesce("by_label", "under", "by_job", "by_next").alias("headline")).where("headline IS NOT NULL")


def cvs(docs: DataFrame, placed: DataFrame | None = None, page_height: float = 842.0) -> DataFrame:
    """One record for each CV (doc_id, text): 20 fields of the person, then experience, education and the other lists.

    Each field is what its label says; else what a `label: value` line says in context (labels.context_fields()); else, where
    name, number and phone are all missing, what has the shape of one. placed: the lines with their places (doc_id, page, col,
    pos, text, y, font_size): then the header is taken by height too, and the name is the largest in it.
    """
    rows = lines.of_text(docs.select("doc_id", "text")) if placed is None else placed
    found = lines.sections(rows, lines.heading_kind(F.col("text")))
    head = labels.header_rows(found) if placed is None else geometry.header_rows(found, F.lit(page_height))
    record = people.cv_records(docs)
    # Lines under the heading of jobs count, or all where there is no such heading.
    worked = Window.partitionBy("doc_id")
    part = found.withColumn("_any", F.max(F.col("section") == "experiencia").over(worked)).where((F.col("section") == "experiencia") | ~F.col("_any")).where(F.col("heading").isNull() & ~F.col("section").isin("educacion", "certificaciones"))
    each = experience.jobs(part.select("doc_id", "pos", "text")).where("company IS NOT NULL OR position IS NOT NULL")
    jobs = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("nth", "company", "position", "start", "end", "is_current", "duties"))).alias("jobs"))
    record = record.drop("experience").join(jobs, "doc_id", "left")
    said, context = labelled(rows.select("doc_id", "pos", "text")), labels.context_fields(rows)
    held_ = record.join(said, "doc_id", "left").join(context.select("doc_id", *[F.col(c).alias(f"c_{c}") for c in context.columns if c != "doc_id"]), "doc_id", "left")
    if placed is not None:
        held_ = held_.join(geometry.largest_name(head).withColumnRenamed("name", "largest"), "doc_id", "left")
    held_ = held_.join(docs.select("doc_id", "text"), "doc_id", "left").withColumn("shape", shapes.by_shape(F.coalesce("text", F.lit(""))))
    held_ = held(held_, whole=names.split_name(F.coalesce("full_name", *(["largest"] if placed is not None else []), F.lit(""))))
    whole = F.col("whole")
    given = lambda part: F.nullif(whole[part], F.lit(""))
    held_ = held(held_, lost=F.coalesce("first_names", given("first_names"), "c_first_names").isNull() & F.coalesce("document_number", "c_document_number").isNull() & F.coalesce("phone", "c_phone").isNull())
    shaped = lambda f: F.when(F.col("lost"), F.col("shape")[f])
    first = F.coalesce(given("first_names"), "first_names", "c_first_names", shaped("first_names"))
    last = F.coalesce(F.when(given("first_names").isNotNull(), given("last_names")), "last_names", "c_last_names", shaped("last_names"))
    city = F.coalesce("city", F.when(shapes.may_be_city(F.col("c_city")), F.col("c_city")))
    said = F.when(holds_any(F.lower("text"), ("linkedin.com/in", "github.com")), F.col("text"))
    links = F.transform(F.regexp_extract_all(F.coalesce(said, F.lit("")), F.lit(SOCIAL), F.lit(0)), lambda x: F.when(F.lower(x).startswith("http"), x).otherwise(F.concat(F.lit("https://"), x)))
    out = held_.select(
        "doc_id", first.alias("first_names"), last.alias("last_names"), F.coalesce("document_number", "c_document_number", shaped("document_number")).alias("document_number"), F.coalesce("email", "c_email", shaped("email"), repair.rebuilt_email(F.col("text"), strict=True)).alias("email"),
        F.coalesce("phone", "c_phone", shaped("phone")).alias("phone"), city.alias("city"), F.coalesce("address", "c_address").alias("address"), F.coalesce("nationality", "c_nationality").alias("nationality"), "birth_place", "birth_date",
        F.coalesce("marital_status", "c_marital_status").alias("marital_status"), F.coalesce("gender", "c_gender").alias("gender"), "salary", "availability", "driver_license", "military_card", "professional_card", F.array_distinct(links).alias("social_links"),
        F.col("jobs").alias("experience"), *[c for c in ("education", "skills", "languages", "certifications", "references", "summary")],
    )
    out = written(out)  # names and cities are looked at beside the header's lines, too
    known = out.select("doc_id", F.nullif(F.trim(F.concat_ws(" ", "first_names", "last_names")), F.lit("")).alias("name"), "city")
    return out.join(headlines(head.select("doc_id", "pos", "text"), known), "doc_id", "left")
