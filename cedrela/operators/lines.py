"""Documents as lines: headings, sections, neighbours, labelled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, fold, fold_only, held, strip_bullets

# The headings of each section (folded).
HEADINGS = {
    "perfil": ["perfil", "perfil profesional", "perfil laboral", "resumen", "objetivo", "acerca de mi", "sobre mi", "summary", "profile", "about me"],
    "experiencia": ["experiencia", "experiencia laboral", "experiencia profesional", "trayectoria laboral", "historial laboral", "work experience", "employment history", "experience"],
    "educacion": ["educacion", "formacion", "formacion academica", "estudios", "estudios realizados", "escolaridad", "education", "studies"],
    "habilidades": ["habilidades", "competencias", "aptitudes", "conocimientos", "skills", "key skills", "strengths"],
    "idiomas": ["idiomas", "idioma", "languages"],
    "certificaciones": ["certificaciones", "certificados", "cursos", "diplomados", "capacitaciones", "talleres", "seminarios", "certifications", "courses", "training"],
    "referencias": ["referencias", "referencias personales", "referencias familiares", "referencias laborales", "references"],
    "contacto": ["contacto", "datos personales", "datos de contacto", "informacion personal", "contact", "personal information"],
}


def of_text(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), text: lines with something in them, in order. pos counts blank lines, too."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", "pos", F.trim("text").alias("text")).where("text != ''")


#: Nine words at most, bullets aside: what a heading of six with two numberings and a colon may be.
SHORT_LINE = r"^[\s•●▪◦*·–—-]*+(?:\S++\s*+){0,9}+$"


def heading_kind(text: Column) -> Column:
    """The section that a line announces, or null: a known heading of six words at most, numbering, bullets and a colon aside."""
    x = F.regexp_replace(F.regexp_replace(fold(strip_bullets(text)), r"^[0-9]+[.)]\s*", ""), r"\s*:\s*$", "")
    kinds = F.create_map(*[F.lit(v) for kind, terms in HEADINGS.items() for t in terms for v in (t, kind)])
    return F.when(text.rlike(SHORT_LINE), bind(x, lambda x: F.when(F.size(F.split(x, " ")) <= 6, kinds[x])))


def sections(lines: DataFrame, heading: Column) -> DataFrame:
    """lines with section_id (0 before the first heading) and section (`encabezado` there): each line is under the last
    heading before it."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("heading", heading)
    return marked.withColumn("section_id", F.count("heading").over(w)).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("encabezado")))


def section_text(found: DataFrame) -> DataFrame:
    """doc_id, section, n_lines, text: all lines of all sections of a kind, headings aside."""
    got = F.sort_array(F.collect_list(F.struct("pos", "text")))
    rows = found.where("heading IS NULL")
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(got, lambda x: x["text"]), "\n").alias("text"))


def nearest_above(value: Column, n: int, by: str = "pos") -> Column:
    """The last value that isn't null among the n rows before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(by).rowsBetween(-n, -1))


def nearest_below(value: Column, n: int, by: str = "pos") -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(by).rowsBetween(1, n))


def any_within(test: Column, n: int, by: str = "pos") -> Column:
    """Whether one of the n rows before or after passes."""
    w = Window.partitionBy("doc_id").orderBy(by)
    near = [F.coalesce(f(test, k).over(w), F.lit(False)) for k in range(1, n + 1) for f in (F.lag, F.lead)]
    out = near[0]
    for x in near[1:]:
        out = out | x
    return out


def keep_first(rows: DataFrame, key: list[str], by: str = "pos") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id", *key).orderBy(by))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


PAIR = r"([A-Za-zÁÉÍÓÚÑáéíóúñ.º° ]{2,40}?)\s*:\s*([^:|•]*?)(?:\s{2,}|\||•|$)"


def labelled_pairs(lines: DataFrame, *more: str) -> DataFrame:
    """doc_id, pos, nth, label (folded), value: `Label: value` pairs, several in a line where blanks, a bar or a bullet part
    them. Addresses with `://` aren't labels. more: columns of the lines that are kept."""
    plain = F.regexp_replace("text", r"[A-Za-z]+://\S*", "")
    parts = F.filter(F.split(plain, r"\s{2,}|\||•"), lambda p: p.rlike(r"^[^:]{2,40}:"))
    each = lines.where(F.contains("text", F.lit(":"))).select("doc_id", "pos", *more, F.posexplode(parts).alias("nth", "part"))
    return each.select("doc_id", "pos", "nth", fold(F.substring_index("part", ":", 1)).alias("label"), F.trim(F.regexp_replace("part", r"^[^:]*:", "")).alias("value"), *more)


def label_values(lines: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """doc_id and the fields: each field's label_value(), all out of one pass over the lines."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    is_label = lambda c: F.coalesce(c.rlike(r":\s*$"), F.lit(False))
    nexts = lines.select("doc_id", "pos", "text", F.lead("text", 1).over(w).alias("n1"), F.lead("text", 2).over(w).alias("n2"))
    below = F.when(~is_label(F.col("n1")), F.col("n1")).when(~is_label(F.col("n2")), F.col("n2"))
    pairs = labelled_pairs(nexts, "n1", "n2").withColumn("value", F.when(F.col("value") == "", below).otherwise(F.col("value"))).where("value IS NOT NULL")
    ranks = {}
    for field, labels in fields.items():
        part = F.lit(False)
        for x in labels:
            part = part | F.col("label").startswith(f"{x} ") | F.col("label").endswith(f" {x}")
        ranks[field] = F.when(F.col("label").isin(*labels), 0).when(part, 1)
    ranked = held(pairs, ranks=F.struct(*[r.alias(f) for f, r in ranks.items()]))
    best = lambda f: F.min_by("value", F.when(F.col(f"ranks.{f}").isNotNull(), F.struct(f"ranks.{f}", "pos", "nth")))
    return ranked.groupBy("doc_id").agg(*[best(f).alias(f) for f in fields])


def label_value(lines: DataFrame, labels: list[str]) -> DataFrame:
    """doc_id, value: the first value of one of the labels: an exact label, else one that begins or ends with it; if the
    label stands alone, the value is the next line that isn't a label itself (two lines on at most)."""
    return label_values(lines, {"value": labels}).where("value IS NOT NULL")


def context_flags(lines: DataFrame) -> DataFrame:
    """Each line with is_upper, is_bullet, has_number, n_words: what headings and builders look at."""
    letters = F.regexp_replace("text", "[^A-Za-zÁÉÍÓÚÑáéíóúñ]", "")
    return lines.select(
        "doc_id", "pos", "text",
        ((F.length(letters) >= 3) & (F.upper(letters) == letters)).alias("is_upper"),
        F.col("text").rlike(r"^[•●▪*–-]|^[0-9]{1,2}[.)]\s").alias("is_bullet"),
        fold_only(F.col("text")).rlike("[0-9]").alias("has_number"),
        F.size(F.split("text", r"\s+")).alias("n_words"),
    )
