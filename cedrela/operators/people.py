"""CVs and contracts from text: fields by label, by section and by shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, dictionaries, names, numbers, repair, shapes
from ..functions.text import fold, fold_only, fold_only_text, held, holds_any, strip_bullets
from . import lines
from .parsers import EMPLOYER, EMPLOYER_WORDS, POSITION, POSITION_WORDS, WORKER, WORKER_WORDS, _get, after_date_label, found_first, if_said

LANGUAGES = ["espanol", "ingles", "frances", "aleman", "italiano", "portugues", "chino", "japones", "ruso"]
LEVELS = "basico|intermedio|avanzado|nativo|a1|a2|b1|b2|c1|c2"
DEGREES = [("posgrado|maestria|especializa|doctorad", "posgrado"), ("tecnolog", "tecnologo"), ("tecnic", "tecnico"), ("bachiller|secundaria", "bachillerato"), ("primaria", "primaria")]
COMPANY = r"(?:s\.?a\.?s\.?|ltda\.?|s\.?a\.?|e\.?s\.?p\.?)$"
#: Words of which one stands in each match of numbers.SALARY.
PAY_WORDS = ("salario", "sueldo", "remuneracion", "asignacion")
CONTRACT_TYPES = [("indefinido", "termino_indefinido"), ("termino fijo", "termino_fijo"), ("obra o labor", "obra_labor"), ("prestacion de servicios", "prestacion_servicios"), ("aprendizaje", "aprendizaje")]


# What a line must say to count where its CV has no such section, and so all lines are looked at (folded).
SCHOOLED = r"\b(?:bachiller|primaria|secundaria|tecnic[oa]s?\b|tecnolog[oa]s?\b|universi|ingenier|licenciad|especializa|maestria|colegio|instituto|sena\b)"
SCHOOL, WORKED = r"\b(?:universidad|colegio|instituto|sena|escuela|academia)\b", r"\b(?:experiencia|anos de|responsable|lider|encargad)"
CERTIFIED = r"\b(?:diplomado|certificacion|certificad[oa]|curso|seminario|taller|capacitacion|scrum\s+master|aws\s+certified|itil|pmp|six\s+sigma)\b"
REFEREE = r"\breferencias?\b"
PROFILE = r"\b(?:experiencia|profesional|anos|trayectoria|especialista|especializad[oa]|liderando|enfocad[oa]|conocimientos|habilidades|capacidad|gestion|desarrollo|sector|responsable|orientad[oa]|apasionad[oa]|graduad[oa]|egresad[oa]|tecnic[oa]|tecnolog[oa]|ingenier[oa]|administradora?|contadora?|psicolog[oa]|disenadora?|experienced|professional|years|skilled|knowledgeable|proactiv[oa])\b"
#: Stems of which one stands in each match of a pattern, and which are quicker to look for.
STEMS = {
    SCHOOLED: ("bachiller", "primaria", "secundaria", "tecnic", "tecnolog", "universi", "ingenier", "licenciad", "especializa", "maestria", "colegio", "instituto", "sena"),
    CERTIFIED: ("diplomado", "certifi", "curso", "seminario", "taller", "capacitacion", "scrum", "itil", "pmp", "sigma"),
    REFEREE: ("referencia",),
    PROFILE: ("xperienc", "profes", "anos", "trayectoria", "especiali", "liderando", "enfocad", "conocimientos", "habilidades", "capacidad", "gestion", "desarrollo", "sector", "responsable", "orientad", "apasionad", "graduad", "egresad", "tecni", "tecnolog", "ingenier", "administrador", "contador", "psicolog", "disenador", "years", "skilled", "knowledgeable", "proactiv"),
}
#: So many lines are the top of the first page, and in the header wherever headings stand.
TOP_LINES = 12


def education_level(folded: Column) -> Column:
    out = F.lit("universitario")
    for pattern, level in reversed(DEGREES):
        out = F.when(folded.rlike(pattern), level).otherwise(out)
    return out


def languages_in(folded: Column) -> Column:
    """array of (language, level): all languages of a line; the level is the first after the language up to a bar, comma or semicolon,
    else one before it there."""

    def each(part: Column) -> Column:
        found = lambda p: F.nullif(F.regexp_extract(part, p, 1), F.lit(""))
        level = lambda t: F.coalesce(found(rf"\b{t}\b.*?\b({LEVELS})\b"), found(rf"\b({LEVELS})\b"), F.lit("intermedio"))
        return F.array_compact(F.array(*[F.when(part.rlike(rf"\b{t}\b"), F.struct(F.lit(t).alias("language"), level(t).alias("level"))) for t in LANGUAGES]))

    return F.when(holds_any(folded, LANGUAGES) & folded.rlike(rf"\b(?:{'|'.join(LANGUAGES)})\b"), F.flatten(F.transform(F.split(folded, r"[|,;]"), each)))


def cv_records(docs: DataFrame) -> DataFrame:
    """One record for each text: identity by labels and shapes, then the sections' items.

    doc_id, first_names, last_names, document_number, email, phone, city, experience (company, position, start, end),
    education (level, text), skills, languages (language, level), certifications, references (name, phone), summary.
    Lines are laid out and dealt out by document once; each section's items are an aggregation by document. What a whole text
    gives is found before records are joined, so that texts aren't shuffled. A name that no label gives is the first in
    the header, however long that is: the lines before the first heading, those about contact and the top of the first page,
    those of references aside. The summary is whole. Where a CV has no section for some items, they are looked for in all lines.
    """
    all_lines = lines.of_text(docs.select("doc_id", "text")).repartition("doc_id")
    found = lines.sections(all_lines, lines.heading_kind(F.col("text")))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    in_header = (F.col("section").isin("encabezado", "contacto") | (F.col("nth") <= TOP_LINES)) & (F.col("section") != "referencias") & F.col("heading").isNull()
    w = Window.partitionBy("doc_id")
    found = found.withColumns({f"any_{s}": F.max((F.col("section") == s) & F.col("heading").isNull()).over(w) for s in ("experiencia", "educacion", "idiomas", "certificaciones", "referencias")})
    found = held(found, f=fold_only(F.col("text")))
    x, f = F.col("text"), F.col("f")
    plain = strip_bullets(x)

    found = held(found, span=F.when(x.rlike(dates.YEAR), dates.date_range(fold_only(x))))
    span = F.col("span")
    found = found.withColumn("before", lines.nearest_above(F.when(span["start"].isNull() & ~F.contains(x, F.lit(":")), x), 3))
    rest = F.trim(F.regexp_replace(F.regexp_replace(fold_only(x), dates.RANGE, ""), r"^[\s|,;:-]+|[\s|,;:-]+$", ""))
    job = F.when(span["start"].isNotNull(), F.struct(F.col("before").alias("company"), F.nullif(rest, F.lit("")).alias("position"), span["start"].alias("start"), span["end"].alias("end")))

    schooled = f.rlike("bachiller|primaria|secundaria|tecnic|tecnolog|universi|ingenier|licenciad|especializa|maestria|colegio|instituto|sena")
    school = F.struct(education_level(f).alias("level"), plain.alias("text"), dates.last_year(x).alias("year"))
    number = numbers.phone(x)
    referee = F.when(number.isNotNull(), F.struct(F.nullif(F.trim(F.regexp_replace(F.replace(plain, number, F.lit("")), r"[^A-Za-zÁÉÍÓÚÑáéíóúñ ]+", " ")), F.lit("")).alias("name"), number.alias("phone")))

    labelled = lines.label_values(all_lines, {"l_first": ["nombres", "nombre"], "l_last": ["apellidos", "apellido"], "l_city": ["ciudad", "municipio", "residencia", "direccion"]})
    shaped = in_header & F.length(x).between(4, 70) & names.looks_like_name(x) & (F.size(F.split(fold(x), " ")) >= 2) & ~fold(x).rlike("hoja de vida|curriculum") & ~shapes.is_job_not_city(x) & ~shapes.has_job(x)
    # What each line gives, its section deciding for what it is looked at; then one aggregation by document.
    said_in = lambda s: (F.col("section") == s) & F.col("heading").isNull()
    missing = lambda s: ~F.col(f"any_{s}") & F.col("heading").isNull()
    says = lambda pattern: holds_any(f, STEMS[pattern]) & f.rlike(pattern)
    prose = in_header & F.length(plain).between(45, 600) & says(PROFILE) & ~F.contains(x, F.lit("@")) & ~x.rlike(r"https?:|www\.")
    given = {
        "experience": F.when(said_in("experiencia") | (missing("experiencia") & ~F.col("section").isin("educacion", "certificaciones")), job),
        "education": F.when((said_in("educacion") & schooled) | (missing("educacion") & says(SCHOOLED) & (~f.rlike(WORKED) | f.rlike(SCHOOL))), school),
        "languages": F.when(said_in("idiomas") | missing("idiomas"), languages_in(f)),
        "certifications": F.when((said_in("certificaciones") & (F.length(plain) > 3)) | (missing("certificaciones") & (F.length(plain) >= 6) & says(CERTIFIED)), plain),
        "references": F.when(said_in("referencias") | (missing("referencias") & says(REFEREE)), referee),
        "s": F.when(said_in("perfil"), x), "prose": F.when(prose, plain),
    }
    said = held(found, v=F.struct(*[v.alias(name) for name, v in given.items()], F.when(shaped, x).alias("shaped"))).where(" OR ".join(f"v.{name} IS NOT NULL" for name in [*given, "shaped"]))
    got = lambda name: F.array_sort(F.collect_list(F.when(F.col(f"v.{name}").isNotNull(), F.struct("pos", F.col(f"v.{name}").alias("v")))))
    listed = lambda name: F.transform(F.when(F.size(name) > 0, F.col(name)), lambda r: r["v"])
    items = said.groupBy("doc_id").agg(*[got(name).alias(name) for name in given], F.min_by("v.shaped", F.when(F.col("v.shaped").isNotNull(), F.col("pos"))).alias("shaped"))
    summary, spoken = F.array_join(listed("s"), " "), F.flatten(listed("languages"))
    names_of = F.transform(spoken, lambda r: r["language"])
    lists = {name: F.array_distinct(listed(name)) for name in ("experience", "education", "certifications", "references")} | {"languages": F.filter(spoken, lambda r, i: F.array_position(names_of, r["language"]) == i + 1)}
    items = items.select("doc_id", "shaped", *[v.alias(name) for name, v in lists.items()], F.when(F.length(summary) >= 20, summary).otherwise(F.array_join(listed("prose"), " ")).alias("summary"))

    folded = F.col("folded")
    texts = held(docs.select("doc_id", "text"), folded=fold_only_text(x))
    texts = held(texts, document=numbers.document_in_text(folded), contact=F.when(holds_any(folded, ("cel", "tel", "movil", "whatsapp", "contacto")), F.regexp_extract(folded, r"(?:cel|tel|movil|whatsapp|contacto)[a-z]*\.?\s*[:.-]?\s*([^\n]*)", 1)))
    texts = texts.select(
        "doc_id", "document", repair.email_in(x, folded).alias("email"), numbers.phone(F.col("contact"), F.col("document")).alias("phone"),
        dictionaries.find_place(folded, folded=True).alias("place"), dictionaries.skills(folded, folded=True).alias("skills"),
    )
    out = texts.join(labelled, "doc_id", "left").join(items, "doc_id", "left")
    whole = names.split_name(F.coalesce("shaped", F.lit("")))
    return out.select(
        "doc_id",
        F.coalesce("l_first", F.nullif(whole["first_names"], F.lit(""))).alias("first_names"),
        F.coalesce("l_last", F.nullif(whole["last_names"], F.lit(""))).alias("last_names"),
        F.col("document").alias("document_number"),
        "email", "phone",
        F.coalesce(dictionaries.find_place(F.col("l_city")), F.col("place")).alias("city"),
        "experience", "education", "skills", "languages", "certifications", "references", "summary",
    )


def contract_records(docs: DataFrame, default_notice: int = 30, max_trial: int = 60) -> DataFrame:
    """doc_id and the terms of a contract: parties, position, type, salary, dates, months, trial and notice days.

    An end that isn't written follows from start and months; months that aren't written follow from the dates. The type is
    what the text says, a fixed term if it says nothing. No employer is made up.
    """
    x = F.col("folded")
    kind = F.lit("termino_fijo")
    for phrase, name in reversed(CONTRACT_TYPES):
        kind = F.when(F.contains(x, F.lit(phrase)), name).otherwise(kind)
    trial = r"periodo\s+de\s+prueba[^0-9\n]{0,30}([0-9]{1,3})\s*(dia|mes)"
    month = F.lit(False)
    for m in dates.MONTH_NUMBER:
        month = month | F.contains(x, F.lit(m))
    found = found_first(
        docs,
        employer=if_said(x, _get(x, EMPLOYER), *EMPLOYER_WORDS), worker=if_said(x, _get(x, WORKER), *WORKER_WORDS), job=if_said(x, _get(x, POSITION), *POSITION_WORDS), kind=kind,
        document=numbers.document_in_text(F.coalesce(if_said(x, F.regexp_replace(x, numbers.SALARY, " "), *PAY_WORDS), x)), pay=F.coalesce(if_said(x, F.regexp_extract(x, numbers.SALARY, 0), *PAY_WORDS), F.lit("")),
        begun=if_said(x, after_date_label(x, r"fecha\s+de\s+(?:inicio|ingreso)|inicio"), "inicio", "ingreso"), in_words=F.when(month, F.regexp_extract(x, dates.TEXTUAL, 0)),
        ended=if_said(x, after_date_label(x, r"fecha\s+de\s+(?:terminacion|vencimiento|fin)|vence"), "fecha", "vence"), term=F.regexp_extract(x, dates.TERM, 0), trial=F.coalesce(if_said(x, F.regexp_extract(x, trial, 0), "prueba"), F.lit("")),
        notice=F.coalesce(if_said(x, F.regexp_extract(x, r"(?:preaviso|antelacion|anticipacion)[^0-9\n]{0,40}([0-9]{1,3})\s*dia", 1), "preaviso", "antelacion", "anticipacion"), F.lit("")),
    )
    start = F.coalesce(dates.normal_date(F.col("begun")), dates.textual_date(F.col("in_words"))).try_cast("date")
    length, unit = (F.regexp_extract("trial", trial, k) for k in (1, 2))
    days = F.when(length != "", F.least(length.try_cast("int") * F.when(unit == "mes", 30).otherwise(1), F.lit(max_trial)))
    dated = found.select("*", start.alias("start_date"), dates.normal_date(F.col("ended")).try_cast("date").alias("last_day"), dates.term_months(F.col("term")).alias("n_months"))
    return dated.select(
        "doc_id",
        names.title_case(F.col("employer")).alias("employer_name"),
        names.title_case(F.col("worker")).alias("worker_name"),
        F.col("document").alias("worker_document_number"),
        names.title_case(F.col("job")).alias("position"),
        F.col("kind").alias("contract_type"),
        numbers.salary(F.col("pay")).alias("salary"),
        "start_date",
        F.coalesce("last_day", F.when(F.col("kind") != "termino_indefinido", F.add_months("start_date", F.col("n_months")))).alias("end_date"),
        F.coalesce("n_months", dates.months_between(F.col("start_date"), F.col("last_day"))).alias("months"),
        days.alias("trial_days"),
        F.coalesce(F.nullif("notice", F.lit("")).try_cast("int"), F.lit(default_notice)).alias("notice_days"),
    )
