"""Fields by their labels: cascades over all lines at once, scopes of two parties, records from labelled lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, shapes
from ..functions.numbers import phone
from ..functions.text import fold, fold_only, held, similar, strip_bullets, strip_years
from . import lines
from .people import education_level

# What opens the worker's part of a contract, labels of records and of fields, markers of dates.
WORKER_MARKERS = ("trabajador", "empleado", "contratista", "worker", "employee")
JOB_LABELS = {
    "company": ("empresa", "compania", "entidad", "organizacion", "empleador"), "position": ("cargo", "puesto", "posicion", "rol", "denominacion del cargo"), "dates": ("fecha", "fechas", "periodo", "duracion", "vinculacion"),
    "duties": ("funciones", "responsabilidades", "logros", "actividades"),
}
STUDY_LABELS = {
    "level": ("nivel", "nivel educativo", "nivel de estudios"), "degree": ("titulo", "titulo obtenido", "programa", "carrera", "grado"), "institution": ("institucion", "universidad", "colegio", "entidad educativa", "centro educativo"),
}
DATE_MARKS = "fecha|vencimiento|iniciaci|finalizaci|terminaci"
#: Fields of `label: value` lines, with what a label holds, in the order in which the first that fits counts.
CONTEXT = {
    "document_number": ("cedula", "cc", "documento", "identificacion"), "phone": ("tel", "cel", "movil", "whatsapp"), "email": ("correo", "email", "mail"), "name": ("nombre",), "city": ("ciudad", "lugar", "municipio"),
    "address": ("direccion", "domicilio"), "nationality": ("nacionalidad",), "marital_status": ("estado civil",), "gender": ("sexo", "genero"),
}

#: Least similarity of a misread label, longest value and most words of one on the next line.
LABEL_SIMILARITY, VALUE_LENGTH, VALUE_WORDS = 0.78, 90, 12


def with_folded(rows: DataFrame) -> DataFrame:
    """rows with `folded`, the line as rules compare it, computed once."""
    return rows if "folded" in rows.columns else held(rows, folded=fold(F.col("text")))


def in_scopes(rows: DataFrame, markers: tuple[str, ...] = WORKER_MARKERS) -> DataFrame:
    """rows with `scope`: employer before the first line that opens the worker's part, worker from there on; null where there
    is no such line. A part of one line is no part (null, too)."""
    rows = with_folded(rows)
    head = F.trim(F.regexp_replace("folded", r"[:.]\s*$", ""))
    opens = F.when(F.col("folded").rlike(rf"^(?:{'|'.join(markers)})"), head.rlike(rf"^(?:{'|'.join(markers)})(?:\z|:? )"))
    all_rows = Window.partitionBy("doc_id")
    cut = F.min(F.when(opens, F.col("pos"))).over(all_rows)
    side = F.when(F.col("pos") < cut, "employer").when(F.col("pos") >= cut, "worker")
    marked = rows.withColumn("side", side)
    return marked.withColumn("scope", F.when(F.count("*").over(Window.partitionBy("doc_id", "side")) >= 2, F.col("side"))).drop("side")


#: A line of five words at most: what a label without its last sign may be.
FEW_WORDS = r"^\s*+(?:\S++\s++){0,4}+\S*+\s*+$"


def candidates(rows: DataFrame) -> DataFrame:
    """doc_id, pos, nth, scope, label (folded), value, alone: `label: value` pairs, and short lines that may be a label with
    the value on one of the next two lines (alone). Such a value has 2 to 90 characters, twelve words at most, no pair in it
    and no colon at its end. Pairs without a value are lines that may be a label."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    pair = r"^[^:]{2,40}:\s*\S"
    usable = lambda c: F.length(c).between(2, VALUE_LENGTH) & ~c.rlike(r"[:;]\s*$") & ~c.rlike(pair) & (shapes.n_words(c) <= VALUE_WORDS)
    n1, n2 = (F.lead("text", k).over(w) for k in (1, 2))
    near = rows.withColumn("n1", n1).withColumn("n2", n2)
    below = F.when(usable(F.col("n1")), F.col("n1")).when(usable(F.col("n2")), F.col("n2"))
    parts = F.filter(F.split(F.regexp_replace("text", r"[A-Za-z]+://\S*", ""), r"\s{2,}|\||•"), lambda p: p.rlike(pair))
    near = held(near, parts=F.when(F.contains("text", F.lit(":")), parts).otherwise(F.array().cast("array<string>")), bare=strip_bullets(F.col("text")))
    near = held(near, row=F.when((F.size("parts") == 0) & F.col("bare").rlike(FEW_WORDS), fold(F.regexp_replace("bare", r"\s*[:.]$", ""))))
    near = held(near, below=F.when((F.length("row") >= 3) & (shapes.n_words(F.col("row")) <= 4), below))
    pairs = F.transform("parts", lambda p, i: F.struct(i.alias("nth"), fold(F.substring_index(p, ":", 1)).alias("label"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value"), F.lit(False).alias("alone")))
    head = F.struct(F.lit(0).alias("nth"), F.col("row").alias("label"), F.col("below").alias("value"), F.lit(True).alias("alone"))
    each = held(near, each=F.when(F.col("below").isNotNull(), F.array(head)).otherwise(pairs))
    return each.select("doc_id", "pos", "scope", F.explode("each").alias("c")).select("doc_id", "pos", "scope", "c.*")


def labelled_fields(found: DataFrame, fields: dict[str, list[str]], scopes: dict[str, str] | None = None, valid: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """doc_id and the fields: of candidates(), each field's best by its labels, in one aggregation by document.

    Candidates of the field's scope come first; then pairs with the label itself, pairs whose label begins or ends with it,
    lines with the label alone, and misread labels (similarity of 0.78 or more) of pairs and of lines; then the first in the
    document. `valid` takes a field's value and returns whether it can be one: others are passed over.
    """
    alone, codes, options = F.col("alone"), [], []
    for i, (field, labels) in enumerate(fields.items()):
        part, near = F.lit(False), F.lit(False)
        for x in labels:
            part = part | F.col("label").startswith(f"{x} ") | F.col("label").endswith(f" {x}")
            near = near | similar(F.col("label"), x, LABEL_SIMILARITY)
        codes.append(F.when(F.col("label").isin(*labels), 0).when(part & ~alone, 1).when(near, 2))
        code = F.get("codes", F.lit(i))
        rank = F.when(code == 0, F.when(alone, 2).otherwise(0)).when(code == 1, 1).otherwise(F.when(alone, 4).otherwise(3))
        test = (valid or {}).get(field)
        fits = F.lit(True) if test is None else F.coalesce(test(F.col("value")), F.lit(False))
        away = F.lit(0) if not scopes or field not in scopes else F.when(F.col("scope") == scopes[field], 0).otherwise(1)
        options.append(F.when(code.isNotNull() & fits, F.struct(F.lit(field).alias("field"), away.alias("away"), rank.alias("rank"))))
    # Labels are compared once, and values only looked at under a label of the field.
    said = held(found, codes=F.array(*codes)).where(F.exists("codes", lambda c: c.isNotNull()))
    met = held(said, options=F.array_compact(F.array(*options))).withColumn("o", F.explode("options"))
    key = F.struct("o.away", "o.rank", "pos", "nth")
    return met.groupBy("doc_id").agg(*[F.min_by(F.when(F.col("o.field") == f, F.col("value")), F.when(F.col("o.field") == f, key)).alias(f) for f in fields])


def name_above(rows: DataFrame, anchors: list[str]) -> DataFrame:
    """doc_id, name: of the two lines above the first one that begins with an anchor, the nearest that is a person's name."""
    rows, begins = with_folded(rows), F.col("folded").rlike(rf"^(?:{'|'.join(anchors)})(?:$|[^a-z0-9])")
    w = Window.partitionBy("doc_id").orderBy("pos")
    above = rows.select("doc_id", "pos", "folded", *[F.lag("text", k).over(w).alias(f"up{k}") for k in (1, 2)]).where(begins)
    name = lambda c: F.when(shapes.is_person(F.col(c)), shapes.clean_person(F.col(c)))
    return above.groupBy("doc_id").agg(F.min_by(F.coalesce(name("up1"), name("up2"), F.lit("")), "pos").alias("name")).where("name != ''")


def date_near(rows: DataFrame, labels: list[str]) -> DataFrame:
    """doc_id, day: the first date on a line with one of the labels, else on the next three lines, of which none after
    another label of a date counts. Lines without a date are passed over."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = with_folded(rows)
    named = F.col("folded").rlike(r"(?:^|\s)(?:" + "|".join(labels) + r")(?:$|[\s:])")
    near = rows.select("doc_id", "pos", "text", "folded", *[F.lead("text", k).over(w).alias(f"down{k}") for k in (1, 2, 3)]).where(named)
    day_in = lambda c: F.coalesce(dates.textual_date(fold_only(F.col(c))), dates.first_date(F.col(c)))
    mark = lambda c: F.coalesce(fold(F.col(c)).rlike(DATE_MARKS), F.lit(False))
    m1, m2 = mark("down1"), mark("down2")
    day = F.coalesce(day_in("text"), day_in("down1"), F.when(~m1, day_in("down2")), F.when(~m1 & ~m2, day_in("down3")))
    return held(near, day=day).where("day IS NOT NULL").groupBy("doc_id").agg(F.min_by("day", "pos").alias("day"))


def _kind(label: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[F.lit(v) for k, names in kinds.items() for n in names for v in (n, k)])[label]


def job_records(pairs: DataFrame) -> DataFrame:
    """doc_id, nth, company, position, start, end, is_current, duties: jobs from labelled pairs (lines.labelled_pairs()).

    Each company after the first begins a record; of a field that stands in a record twice, the last counts. A record without
    company and position is none. A label without a value has the empty one.
    """
    at = Window.partitionBy("doc_id").orderBy("pos", "nth")
    kept = pairs.withColumn("kind", _kind(F.col("label"), JOB_LABELS)).where("kind IS NOT NULL")
    record = F.greatest(F.sum(((F.col("kind") == "company") & (F.col("value") != "")).cast("int")).over(at), F.lit(1))
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.struct("pos", "nth")))
    out = kept.withColumn("record", record).groupBy("doc_id", "record").agg(*[last(k).alias(k) for k in JOB_LABELS])
    span = dates.date_range(fold_only(F.col("dates")))
    out = out.where("coalesce(company, '') != '' OR coalesce(position, '') != ''")
    return out.select("doc_id", F.col("record").cast("int").alias("nth"), "company", "position", span["start"].alias("start"), span["end"].alias("end"), F.coalesce(span["current"], F.lit(False)).alias("is_current"), "duties")


def study_records(pairs: DataFrame) -> DataFrame:
    """doc_id, nth, level, degree, institution, end_year: studies from labelled pairs.

    An institution ends a record, and a second level begins one. A record needs a degree or an institution; the degree is the
    institution where there is none, the level what the text of the degree says.
    """
    at = Window.partitionBy("doc_id").orderBy("pos", "nth")
    kept = pairs.withColumn("kind", _kind(F.col("label"), STUDY_LABELS)).where("kind IS NOT NULL")
    ended = F.coalesce(F.sum((F.col("kind") == "institution").cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("part", ended)
    level = F.sum((F.col("kind") == "level").cast("int")).over(Window.partitionBy("doc_id", "part").orderBy("pos", "nth"))
    kept = kept.withColumn("sub", F.greatest(level, F.lit(1)))
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.struct("pos", "nth")))
    out = kept.groupBy("doc_id", "part", "sub").agg(*[last(k).alias(k) for k in STUDY_LABELS]).where("degree IS NOT NULL OR institution IS NOT NULL")
    degree, school = strip_years(F.col("degree")), strip_years(F.col("institution"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "sub"))
    level = education_level(fold(F.coalesce("level", "degree", F.lit(""))))
    return out.select("doc_id", nth.alias("nth"), level.alias("level"), F.coalesce(degree, school).alias("degree"), F.coalesce(school, F.lit("")).alias("institution"), dates.last_year(F.col("institution")).alias("end_year"))


def context_fields(rows: DataFrame) -> DataFrame:
    """doc_id and fields of `label: value` lines: of number, phone and e-mail the last, of the others the first that fits.
    A name needs two words, of which the last is the surname; a city mustn't be a job."""
    label, value = F.trim(F.regexp_extract("text", r"^([^:]{2,40}):\s*(.+)$", 1)), F.trim(F.regexp_extract("text", r"^([^:]{2,40}):\s*(.+)$", 2))
    at = held(rows.where(F.contains("text", F.lit(":"))).select("doc_id", "pos", value.alias("value"), label.alias("said")), label=fold(F.col("said"))).where("label != ''")
    kind = F.lit(None).cast("string")
    for name, words in reversed(CONTEXT.items()):
        kind = F.when(F.col("label").rlike("|".join(words)), name).otherwise(kind)
    v, first = F.col("value"), F.trim(F.regexp_extract("value", "^[^|,;]*", 0))
    city = F.substring(first, 1, 50)
    values = {
        "document_number": F.replace(shapes.found(v, r"\b[0-9.]{7,12}\b", 0), F.lit(".")), "phone": shapes.found(v, r"\b3[0-9]{9}\b", 0), "email": F.lower(shapes.found(v, shapes.ADDRESS, 0)), "name": F.when(shapes.n_words(v) >= 2, v),
        "city": F.when((F.length(city) > 2) & ~shapes.is_job_not_city(city), city), "address": F.substring(first, 1, 80), "nationality": first, "marital_status": first, "gender": first,
    }
    got = at.withColumn("kind", kind).where("kind IS NOT NULL")
    fits = F.lit(None).cast("string")
    for name, x in values.items():
        fits = F.when(F.col("kind") == name, F.nullif(x, F.lit(""))).otherwise(fits)
    got = got.withColumn("x", fits).where("x IS NOT NULL")
    pick = lambda k: (F.max_by if k in ("document_number", "phone", "email") else F.min_by)(F.when(F.col("kind") == k, F.col("x")), F.when(F.col("kind") == k, F.col("pos")))
    out = got.groupBy("doc_id").agg(*[pick(k).alias(k) for k in CONTEXT])
    surname = F.regexp_extract("name", r"(\S+)$", 1)
    return out.withColumn("first_names", F.regexp_replace("name", r"\s+\S+$", "")).withColumn("last_names", surname).drop("name")


def own_email(rows: DataFrame) -> DataFrame:
    """doc_id, email: the first address that isn't a reference's: no line about references beside it, and no name and phone
    on its own line."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    about = F.concat_ws(" ", F.lag("text").over(w), "text", F.lead("text").over(w))
    mail = shapes.found(F.col("text"), shapes.ADDRESS, 0)
    other = F.col("about").rlike("(?i)referenc") | (phone(F.col("text")).isNotNull() & F.col("text").rlike(r"^\s*[A-ZÁÉÍÓÚ][a-záéíóú]+\s+[A-ZÁÉÍÓÚ]"))
    return rows.withColumn("about", about).withColumn("email", mail).where(F.col("email").isNotNull() & ~other).groupBy("doc_id").agg(F.min_by("email", "pos").alias("email"))


def header_rows(found: DataFrame, least: int = 3, first: int = 12) -> DataFrame:
    """Of lines in sections (lines.sections()), those before the first heading or about contact; of documents with fewer than
    `least` of them, the `first` ones. Lines of references never count."""
    heads = F.col("section").isin("encabezado", "contacto")
    marked = found.withColumn("n_heads", F.sum(heads.cast("int")).over(Window.partitionBy("doc_id"))).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    keep = F.when(F.col("n_heads") >= least, heads).otherwise(F.col("nth") <= first)
    return marked.where(keep & (F.col("section") != "referencias")).drop("n_heads", "nth")


# Labels of a contract's fields.
PARTY_LABELS = {
    "employer_name": ["empleador", "nombre del empleador", "empresa", "razon social", "empresa empleadora"],
    "employer_tax_id": ["nit", "rut", "nit del empleador", "identificacion tributaria", "numero de nit", "nit no", "no nit"],
    "employer_email": ["correo electronico del empleador", "correo del empleador", "correo de la empresa", "correo electronico", "correo", "email", "e-mail"],
    "employer_address": ["domicilio del empleador", "direccion del empleador", "direccion de la empresa", "domicilio", "direccion"],
    "worker_name": ["trabajador", "nombre del trabajador", "empleado", "nombre del empleado", "contratista"],
    "worker_document_number": ["cedula", "cedula de ciudadania", "cedula del trabajador", "documento", "documento de identidad", "identificacion"],
    "worker_email": ["correo electronico del trabajador", "correo del trabajador", "correo del empleado", "correo electronico", "correo", "email", "e-mail"],
    "worker_address": ["domicilio del trabajador", "direccion del trabajador", "residencia del trabajador", "domicilio", "direccion", "residencia"],
    "position": ["cargo", "cargo a desempenar", "oficio", "puesto"],
    "salary": ["salario", "salario basico", "salario mensual", "sueldo", "remuneracion"],
}
BIRTH_LABELS = ["fecha de nacimiento", "fecha nacimiento", "nacimiento"]
START_LABELS, END_LABELS = ["fecha de inicio", "fecha de iniciacion", "fecha de ingreso", "iniciacion de labores"], ["fecha de terminacion", "fecha de vencimiento", "fecha de finalizacion", "vencimiento"]


def contract_parties(docs: DataFrame, not_from: tuple[str, ...] = (), rows: DataFrame | None = None, pairs: DataFrame | None = None, dated: DataFrame | None = None) -> DataFrame:
    """doc_id, employer_name, employer_tax_id, employer_email, employer_address, worker_name, worker_document_number,
    worker_email, worker_address, position, salary, start_date, end_date of every document (doc_id, text).

    Fields come from their labels, those of a party from its part of the text first. What is still missing: the worker's name
    from the lines above the data of a person, an e-mail of the worker's part that isn't the employer's, a tax number and an
    identity number anywhere, the job and the pay from a sentence. not_from: beginnings of numbers that are no person's.
    Nothing is filled in that the text doesn't hold. A null or empty text has nulls only; repeated doc_ids are one document.
    Where lines have places on pages, rows are these lines with their scope, pairs what geometry adds to candidates(), dated
    the lines in which dates are looked for (geometry.label_pairs()); else all are taken from the text.
    """
    rows = in_scopes(lines.of_text(docs)) if rows is None else rows
    number = lambda v: F.regexp_replace(F.regexp_extract(v, r"^[^(;]*", 0), "[^0-9]", "")
    mail = lambda v: F.lower(shapes.found(v, shapes.ADDRESS, 0))
    named = lambda v: ~shapes.is_notice(v) & ~shapes.is_address(v) & (shapes.is_person(v) | shapes.is_firm(v))
    pay = lambda v: shapes.pay_in(F.concat(F.lit("pago: "), v))
    identity = lambda v: F.length(number(v)).between(6, 10) & ~v.rlike("(?i)nit|rut")
    for begin in not_from:
        identity = lambda v, inner=identity, begin=begin: inner(v) & ~number(v).startswith(begin)
    valid = {
        "employer_name": lambda v: named(v) | (~shapes.is_notice(v) & ~v.rlike("[0-9]")), "employer_tax_id": lambda v: v.rlike("[0-9]"), "employer_email": lambda v: mail(v).isNotNull(), "worker_name": named,
        "worker_document_number": identity, "worker_email": lambda v: mail(v).isNotNull(), "position": lambda v: ~v.rlike("[0-9]"), "salary": lambda v: pay(v).isNotNull(),
    }
    scopes = {f: f.split("_")[0] for f in PARTY_LABELS if f.split("_")[0] in ("employer", "worker")}
    said = candidates(rows)
    found = labelled_fields(said if pairs is None else said.unionByName(pairs), PARTY_LABELS, scopes, valid)
    above = name_above(rows, BIRTH_LABELS + ["domicilio del trabajador", "correo del trabajador"]).withColumnRenamed("name", "above")
    others = F.array_sort(F.collect_list(F.when((F.col("scope") == "worker") & F.col("m").isNotNull(), F.struct("pos", "m"))))
    mails = held(rows.where("scope = 'worker' AND contains(text, '@')"), m=mail(F.col("text"))).where("m IS NOT NULL").groupBy("doc_id").agg(F.transform(others, lambda s: s["m"]).alias("mails"))
    start, end = date_near(rows if dated is None else dated, START_LABELS).withColumnRenamed("day", "start_date"), date_near(rows if dated is None else dated, END_LABELS).withColumnRenamed("day", "end_date")
    out = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    for part in (found, above, mails, start, end):
        out = out.join(part, "doc_id", "left")
    out = held(out, tax=F.coalesce(shapes.tax_id(F.col("employer_tax_id")), shapes.tax_id_in(F.col("text"))))
    tax = F.col("tax")
    employer_mail = mail(F.col("employer_email"))
    labelled_mail = mail(F.col("worker_email"))
    own_mail = F.coalesce(F.when(~F.coalesce(labelled_mail == employer_mail, F.lit(False)), labelled_mail), F.try_element_at(F.filter("mails", lambda m: m != F.coalesce(employer_mail, F.lit(""))), F.lit(1)))
    value = lambda c: F.trim(F.regexp_replace(c, r"[\s|•*]+$", ""))
    return out.select(
        "doc_id",
        value("employer_name").alias("employer_name"), tax.alias("employer_tax_id"), employer_mail.alias("employer_email"), value("employer_address").alias("employer_address"),
        F.coalesce(F.nullif(shapes.clean_person(F.col("worker_name")), F.lit("")), "above").alias("worker_name"),
        F.coalesce(number(F.col("worker_document_number")), shapes.generic_id(F.col("text"), tax, not_from)).alias("worker_document_number"), own_mail.alias("worker_email"), value("worker_address").alias("worker_address"),
        F.coalesce(value("position"), shapes.job_in_prose(F.col("text"))).alias("position"), F.coalesce(pay(F.col("salary")), shapes.pay_in(F.col("text"))).alias("salary"), "start_date", "end_date",
    )
