"""One person from many records: identity, index and sheet, notices, corrections and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence, readings

#: The points of a candidate's fields for the sheet (both names 5) and for the index.
SHEET_POINTS = {"document_number": 3, "phone": 2, "email": 2, "birth_date": 1}
INDEX_POINTS = {"first_names": 1, "last_names": 1, "document_number": 2, "phone": 1, "city": 1}
#: Paths of the sections; the first stands for unknown ones.
SECTIONS = ("lector", "candidatos", "empleados", "expediente", "contratos", "vacantes", "memorandos", "liquidaciones", "alertas", "dashboard", "reportes", "configuracion")
CITED = r"(?im)(?:C[.:]?\s*C\s*[.:]?\s*|CEDULA\s*DE\s*CIUDADANIA|^CC\b)\s*[:.]?\s*([1-9][0-9 .,]{6,14}[0-9])"


def given(x: Column) -> Column:
    """The value, null if empty."""
    return F.when(x != "", x)


def first_identity(found: list[tuple[Column, Column, Column]]) -> Column:
    """struct(number, name) of the first (condition, number, name) that holds; nulls if none does."""
    rules = [F.when(condition, F.struct(given(number).alias("number"), given(name).alias("name"))) for condition, number, name in found]
    return F.coalesce(*rules, F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("name")))


def identity(order: str) -> Column:
    """Who a record is about, in one of three orders over its parts (columns <part>_name and <part>_number).

    batch: contract, candidate, health, id card, text, each by name or number. file: contract by name, health by either,
    candidate by number, then a number in the text. history: the first number of candidate, contract, id card, health,
    settlement, text; no name.
    """
    part = lambda p: (F.col(f"{p}_number"), F.col(f"{p}_name"))
    has = lambda x: evidence.filled(x)
    none = F.lit(None).cast("string")
    if order == "batch":
        return first_identity([(has(n) | has(w), n, w) for n, w in map(part, ("contract", "candidate", "health", "id_card", "text"))])
    if order == "file":
        (c, cw), (h, hw), (k, kw), (t, _) = map(part, ("contract", "health", "candidate", "text"))
        return first_identity([(has(cw), c, cw), (has(h) | has(hw), h, hw), (has(k), k, kw), (has(t), t, none)])
    return first_identity([(has(F.col(f"{p}_number")), F.col(f"{p}_number"), none) for p in ("candidate", "contract", "id_card", "health", "settlement", "text")])


def sheet_points(c: Column) -> Column:
    """The points of a candidate: both names 5, number 3, phone and e-mail 2, birth date 1, experience and education 2 each."""
    out = F.when(evidence.filled(c["first_names"]) & evidence.filled(c["last_names"]), 5).otherwise(0)
    for field, n in SHEET_POINTS.items():
        out = out + F.when(evidence.filled(c[field]), n).otherwise(0)
    return out + F.when(F.size(c["experience"]) > 0, 2).otherwise(0) + F.when(F.size(c["education"]) > 0, 2).otherwise(0)


def index_points(c: Column) -> Column:
    return sum((F.when(evidence.filled(c[f]), n).otherwise(0) for f, n in INDEX_POINTS.items()), F.lit(0))


def best_candidate(points: Column) -> Column:
    """The aggregate of the candidate with the most points, the first record of equals."""
    return F.max_by("candidate", F.struct(F.when(F.col("candidate").isNotNull() & (points > 0), points), -F.col("file")))


def first_of(value: Column) -> Column:
    """The aggregate of the first record's value that isn't empty."""
    return F.min_by(value, F.when(evidence.filled(value), F.col("file")))


def person_index(records: DataFrame) -> DataFrame:
    """folder, documents, contracts, cvs, document_number, job, salary, history of each person.

    records: folder, file (their order), detected, text, candidate (struct), position, salary, subject, id_number. Number and
    job are the first given by a record, else the best candidate's. history holds distinct subjects and kinds, sorted.
    """
    low = F.lower("text")
    kind = F.when(F.col("detected").isin("unknown", "contract", "liquidacion"), evidence.index_kind(low))
    entries = F.concat(F.collect_set(given(F.col("subject"))), F.collect_set(kind))  # distinct in each task already
    found = records.groupBy("folder").agg(
        F.count("*").alias("documents"), F.count_if(F.col("detected") == "contract").alias("contracts"), F.count_if(F.col("detected") == "cv").alias("cvs"),
        first_of(F.col("id_number")).alias("id_number"), first_of(F.col("position")).alias("position"), first_of(F.col("salary")).alias("salary"),
        best_candidate(index_points(F.col("candidate"))).alias("best"), F.array_sort(F.array_distinct(entries)).alias("history"),
    )
    best = lambda f: given(F.col("best")[f])
    return found.select(
        "folder", "documents", "contracts", "cvs", F.coalesce("id_number", best("document_number")).alias("document_number"), F.coalesce("position", best("headline")).alias("job"), "salary", "history",
    )


def person_sheet(records: DataFrame) -> DataFrame:
    """folder, name, points, experience, education, eps, worker_name of each person.

    The best candidate gives the name; lists are the distinct items of all candidates; health takes the last value given;
    worker_name is the longest of the memos', the folder's name if there is none.
    """
    points = sheet_points(F.col("candidate"))
    merged = lambda f: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col("candidate")[f]))))
    memo = given(F.col("memo_name"))
    found = records.groupBy("folder").agg(
        best_candidate(points).alias("best"), F.max(F.when(F.col("candidate").isNotNull(), points)).alias("points"), merged("experience").alias("experience"), merged("education").alias("education"),
        F.max_by(F.col("eps"), F.when(evidence.filled(F.col("eps")), F.col("file"))).alias("eps"), F.max_by(memo, F.when(memo.isNotNull(), F.struct(F.length(memo), -F.col("file")))).alias("memo_name"),
    )
    name = given(F.trim(F.concat_ws(" ", F.col("best")["first_names"], F.col("best")["last_names"])))
    return found.select("folder", name.alias("name"), F.coalesce("points", F.lit(0)).alias("points"), "experience", "education", "eps", F.coalesce("memo_name", "folder").alias("worker_name"))


def most_cited_number(texts: DataFrame) -> DataFrame:
    """folder, number: the identity number (7 to 10 digits) that a folder's texts cite most, the shorter, then smaller of equals."""
    cited = texts.select("folder", F.explode(F.regexp_extract_all("text", F.lit(CITED), F.lit(1))).alias("x")).select("folder", F.regexp_replace("x", "[^0-9]", "").alias("number"))
    counts = cited.where(F.length("number").between(7, 10)).groupBy("folder", "number").count()
    return counts.groupBy("folder").agg(F.min_by("number", F.struct(-F.col("count"), F.length("number"), F.col("number"))).alias("number"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """person, position: the current job, else the one of the latest year in its dates; the first of equals.

    jobs: person, pos, position, is_current, start_date, end_date (texts).
    """
    year = F.regexp_extract(F.concat_ws(" ", "end_date", "start_date"), r"\b(?:19|20)[0-9]{2}\b", 0)
    score = F.when(F.col("is_current"), 9999).otherwise(F.coalesce(given(year).cast("int"), F.lit(0)))
    real = jobs.where(F.length(F.trim("position")) > 2)
    return real.groupBy("person").agg(F.max_by(F.trim("position"), F.struct(score, -F.col("pos"))).alias("position"))


def hire_date(candidates: DataFrame, contracts: DataFrame) -> DataFrame:
    """id, hired: the earliest start of a candidate's contracts, by document number without blanks and dots (hyphens count)."""
    key = lambda x: F.regexp_replace(x, r"[\s.]", "")
    known = contracts.where("worker_document_number != ''").groupBy(key(F.col("worker_document_number")).alias("key")).agg(F.min("start_date").alias("hired"))
    asked = candidates.select("id", key(F.col("document_number")).alias("key"))
    return asked.where("key != ''").join(known, "key").select("id", "hired")


def notices(people: DataFrame) -> DataFrame:
    """id, notices (codes, in order) about what a person's history lacks.

    people: id, status, exit_date, exit_reason, active_contract (boolean), n_contracts, n_memos.
    """
    gone, here = F.col("status") == "inactivo", F.col("status") == "activo"
    rules = [
        (gone & F.col("exit_date").isNull(), "sin_fecha_salida"), (gone & ~evidence.filled(F.col("exit_reason")), "sin_razon_salida"),
        (here & ~F.coalesce("active_contract", F.lit(False)) & (F.col("n_contracts") == 0), "sin_contrato_vigente"), (F.col("n_memos") >= 3, "tres_memorandos"), (here & (F.col("n_contracts") == 0), "sin_contratos"),
    ]
    return people.select("id", F.array_compact(F.array(*[F.when(rule, code) for rule, code in rules])).alias("notices"))


def corrected(rows: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """rows with every field that `corrections` gives for their key put over their own; a null corrects nothing."""
    fields = [c for c in corrections.columns if c != key]
    renamed = corrections.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    out = rows.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def after_actions(rows: DataFrame, actions: DataFrame, states: dict[str, str]) -> DataFrame:
    """rows (id, state ...) with the state that their latest action leads to.

    actions: id, action, at, seq. states: action to state; other actions change nothing.
    """
    known = F.create_map(*[F.lit(v) for pair in states.items() for v in pair])[F.col("action")]
    last = actions.where(F.col("action").isin(*states)).groupBy("id").agg(F.max_by(known, F.struct("at", "seq")).alias("_state"))
    return rows.join(last, "id", "left").select(*[F.coalesce("_state", "state").alias("state") if c == "state" else F.col(c) for c in rows.columns])


def best_readings(pages: DataFrame) -> DataFrame:
    """page, by_data, by_form: the best reading of each page, by distinct data and by points for forms; then by length and
    confidence, then the smallest. pages: page, reading, text, confidence (0 to 1)."""
    scored = pages.select(
        "page", "reading", readings.distinct_data(F.col("text"), readings.READING_DATA).alias("data"), readings.form_points(F.col("text")).alias("form"), readings.reading_points(F.col("text"), F.col("confidence")).alias("points")
    )
    top = lambda c: F.max_by("reading", F.struct(c, "points", -F.col("reading")))
    return scored.groupBy("page").agg(top("data").alias("by_data"), top("form").alias("by_form"))


def route(path: Column, name: str, value: Column) -> Column:
    """The link of a section (unknown ones: the first) with a parameter, which is left out when empty."""
    known = F.when(path.isin(*SECTIONS), path).otherwise(SECTIONS[0])
    return F.concat(F.lit("#/"), known, F.when(evidence.filled(value), F.concat(F.lit(f"?{name}="), F.url_encode(value))).otherwise(""))


def route_parts(link: Column) -> Column:
    """struct(section, params) of a link; an unknown path is the first section."""
    bare = F.regexp_replace(link, "^#/?", "")
    path = F.substring_index(bare, "?", 1)
    query = F.regexp_extract(bare, r"\?([^?]*)", 1)
    params = F.transform_values(F.str_to_map(given(query), F.lit("&"), F.lit("=")), lambda k, v: F.url_decode(v))
    return F.struct(F.when(path.isin(*SECTIONS), path).otherwise(SECTIONS[0]).alias("section"), params.alias("params"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, action: str) -> DataFrame:
    """rows whose parent is gone, by a referential action: `cascade` drops them, `set null` clears their key."""
    present = parents.select(F.col("id").alias(key))
    if action == "cascade":
        kept = rows.join(present, key, "left_semi").select(*rows.columns)
        return kept.unionByName(rows.where(F.col(key).isNull()))
    marked = rows.where(F.col(key).isNotNull()).join(present.withColumn("_present", F.lit(True)), key, "left")
    marked = marked.withColumn(key, F.when(F.col("_present"), F.col(key))).select(*rows.columns)
    return marked.unionByName(rows.where(F.col(key).isNull()))


def orientations(probes: DataFrame) -> DataFrame:
    """page_id, turn: by how many degrees a page is turned, by probes (page_id, turn, chars, confidence, width, height): one of
    each turn.

    Only turns that the upright probe's shape allows count. The best (ties: the smallest turn) must be better than upright by
    a margin and sure enough; an upright page that is clear stays. Pages without an upright probe are left out.
    """
    value = readings.probe_value(F.col("chars"), F.col("confidence"))
    upright = probes.where("turn = 0").select("page_id", readings.plausible_turns(F.col("width"), F.col("height")).alias("turns"), value.alias("upright"), (F.col("chars") >= readings.PROBE_CHARS).alias("read"))
    met = probes.join(upright, "page_id").where(F.array_contains("turns", F.col("turn")))
    best = met.groupBy("page_id", "upright", "read", F.size("turns").alias("n")).agg(F.max_by(F.struct("turn", "confidence"), F.struct(value, -F.col("turn"))).alias("b"), F.max(value).alias("top"))
    clear = (F.col("n") == 2) & F.col("read") & (F.col("upright") >= readings.CLEAR)
    turned = ~clear & (F.col("top") >= F.col("upright") + readings.MARGIN) & (F.col("b.confidence") >= readings.LEAST_SURE)
    return best.select("page_id", F.when(turned, F.col("b.turn")).otherwise(0).alias("turn"))
