"""Evidence, readings and the dossier of a person, over the whole documents, customer and orders tables.

The SQL spells every rule out again; it shares no constant with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import evidence, readings, text
from ..operators import dossier
from . import Catalogue, corpus
from .whole import ALL_TEXTS, texts

C = Catalogue()

ODD = ["Atentamente", "NRTA", "XX", "Ana Prueba", "la señora Ana", "Departamento de Personal", "U OFICIO QUE | ADMINISTRADORA", "OFICIO QueOPERADOR DE MAQUINA", "CARGO", " Bogotá |* ", "x", "", None, "Administración", "Ingeniera Rosa Inventada Ruiz", "a@gmail.com"]
LOW, FOLDED = "lower(coalesce(text, ''))", "translate(lower(coalesce(text, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"


def sql_any(low: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


CV = "contains({0}, 'hoja de vida') OR contains({0}, 'curriculum') OR contains({0}, 'experiencia laboral') OR contains({0}, 'perfil profesional')".format("low")
CONTRACT_POINTS = " + ".join(f"contains(low, '{w}')::INT" for w in "empleador,trabajad,forma de pago,lugar de ejecucion,periodo de prueba,nit,domicilio,termino fijo,clausul,datos personales y de contrato,salario".split(","))


@C.add(rf"""WITH t AS (SELECT doc_id, {LOW} AS low, {FOLDED} AS plain FROM {ALL_TEXTS})
SELECT doc_id, NOT ({CV}) AND ({CONTRACT_POINTS}) >= 2 AND (contains(low, 'empleador') OR contains(low, 'contrato')) AS contract_signals,
  NOT ({CV} OR contains(low, 'datos personales')) AND (regexp_matches(low, 'inasistencia\s+(?:reiterada|sin\s+justa)|sin\s+justa\s+causa|descargos|amonestaci')
    OR 4 * regexp_matches(low, '\b(?:asunto|para|de|memorando|memorandum|llamado\s+de\s+atencion|fecha|referencia)\s*[:.]')::INT
     + 2 * (regexp_matches(low, '\basunto\s*[:./]')::INT + regexp_matches(low, '\bpara\s*[:./]')::INT + regexp_matches(low, '\bde\s*[:./]')::INT) >= 6) AS memo_signals,
  regexp_matches(plain, 'cesantias?\s+|prima\s+de\s+servicios?|vacaciones\s+|intereses?\s+sobre\s+cesantias|auxilio\s+de\s+transporte|indemnizacion\s+por\s+despido|liquidacion\s+y\s+pago\s+total|total\s+a\s+pagar|total\s+a\s+liquidar|concepto\s+de\s+retiro') AS settlement_words,
  regexp_matches(plain, 'empresa\s+empleadora|empleador|razon\s+social') AND regexp_matches(plain, '(?:forma\s+de\s+pago|tipo\s+de\s+contrato|fecha\s+de\s+inicio|fecha\s+de\s+iniciacion|lugar\s+de\s+trabajo|salario|sueldo)\s*[:.-]') AS contract_block
FROM t""")
def evidence_texts(spark: SparkSession, d: str) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    found = texts(spark, d).select("doc_id", F.lower(x).alias("low"), text.fold_only(x).alias("plain"))
    return found.select(
        "doc_id", evidence.contract_signals(F.col("low")).alias("contract_signals"), evidence.memo_signals(F.col("low")).alias("memo_signals"), evidence.settlement_words(F.col("plain")).alias("settlement_words"),
        evidence.contract_block(F.col("plain")).alias("contract_block"),
    )


@C.add(f"""WITH t AS (SELECT doc_id, {LOW} AS low FROM {ALL_TEXTS})
SELECT doc_id, CASE WHEN {sql_any('low', 'renuncia', 'retiro voluntario')} THEN 'Renuncia / retiro' WHEN {sql_any('low', 'hoja de vida', 'curriculum', 'perfil profesional')} THEN 'Hoja de vida' WHEN contains(low, 'memorando') THEN 'Memorando'
    WHEN contains(low, 'llamado de atenci') THEN 'Llamado de atencion' WHEN contains(low, 'vacaciones') AND contains(low, 'disfrut') THEN 'Vacaciones' WHEN contains(low, 'liquidacion') THEN 'Liquidacion'
    WHEN contains(low, 'funciones') AND contains(low, 'cargo') THEN 'Funciones del cargo'
    WHEN (regexp_matches(low, 'consulta.*afiliad') OR {sql_any('low', 'adres', 'seguridad social', 'eps')}) AND contains(low, 'afiliad') THEN 'Salud / EPS' WHEN contains(low, 'contrato') THEN 'Contrato' END AS loose,
  CASE WHEN {sql_any('low', 'renuncia', 'retiro voluntario')} THEN 'Renuncia' WHEN contains(low, 'memorando') THEN 'Memorando' WHEN contains(low, 'llamado de atenci') THEN 'Llamado' WHEN contains(low, 'vacaciones') AND contains(low, 'disfrut') THEN 'Vacaciones'
    WHEN contains(low, 'liquidacion') THEN 'Liquidacion' WHEN contains(low, 'funciones') AND contains(low, 'cargo') THEN 'Funciones' WHEN contains(low, 'afiliad') THEN 'Salud' END AS indexed FROM t""")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    low = texts(spark, d).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return low.select("doc_id", evidence.loose_kind(F.col("low")).alias("loose"), evidence.index_kind(F.col("low")).alias("indexed"))


PLAIN_X = FOLDED.replace("text", "x")
SIGNED = r"atentamente|cordialmente|gerencia|firm[ao]\b|talento\s+humano|recursos\s+humanos|departamento\s+de\s+personal|direccion\s+general|administracion\b|recion\s+humano"


@C.add(rf"""WITH v AS (SELECT c_custkey AS id, c_name AS x FROM customer UNION ALL SELECT -1 - id, x FROM {corpus.listed_sql(ODD)}),
s AS (SELECT id, x, [t FOR t IN string_split_regex(trim(x), '[\s|_:]+') IF t != ''] AS w, trim(coalesce(x, '')) AS s, trim({PLAIN_X}) AS plain, trim(regexp_replace({PLAIN_X}, '\s+', ' ', 'g')) AS folded FROM v),
g AS (SELECT *, length(s) < 3 OR regexp_matches(plain, '{SIGNED}') OR (length(s) <= 6 AND s = upper(s) AND NOT regexp_matches(plain, '[aeiou]')) OR (length(s) <= 3 AND NOT regexp_matches(plain, '[aeiou]')) AS garbage,
  trim(regexp_replace(x, '[\s|•*]+$', '')) AS v,
  regexp_replace(array_to_string(list_slice(w, list_position([translate(lower(t), 'áéíóúñ', 'aeioun') NOT IN ('cargo', 'u', 'a', 'oficio', 'que', 'ha', 'sido', 'desempenara', 'el', 'trabajador', 'v', 'o', '0', '1') FOR t IN w], true), CASE WHEN len(w) > 0 AND list_contains([translate(lower(t), 'áéíóúñ', 'aeioun') NOT IN ('cargo', 'u', 'a', 'oficio', 'que', 'ha', 'sido', 'desempenara', 'el', 'trabajador', 'v', 'o', '0', '1') FOR t IN w], true) THEN len(w) ELSE 0 END), ' '), '^(?:[Qq]ue|[Cc]argo|[Oo]ficio)([A-ZÁÉÍÓÚÑ]{{2}})', '\1') AS j FROM s)
SELECT id, garbage, garbage OR regexp_matches(folded, 'memorando|llamado\s+de\s+atencion|asunto|para\b|de\b|fecha|distribuciones|ceso\s+humano|talento|recurso|emplead|trabajad')
    OR (regexp_matches(folded, '\b(?:el|la|los|las|sr|sra|ingenier[oa]|doctor[oa]|licenciad[oa])\b') AND len(string_split(folded, ' ')) < 3) AS garbage_name,
  CASE WHEN length(v) >= 2 THEN v END AS value, CASE WHEN length(coalesce(j, '')) < 3 THEN x ELSE j END AS job FROM g""")
def short_values(spark: SparkSession, d: str) -> DataFrame:
    given = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("x"))
    x = F.col("x")
    rows = given.union(corpus.listed(spark, ODD).select((-1 - F.col("id")).cast("long"), "x"))
    return rows.select(
        "id", evidence.is_garbage(x).alias("garbage"), F.coalesce(evidence.is_garbage_name(x), F.lit(True)).alias("garbage_name"), evidence.clean_value(x).alias("value"), evidence.clean_job(x).alias("job")
    )


SQL_MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
SQL_WORDS = (
    "datos personales,datos de contacto,informacion personal,perfil profesional,perfil laboral,resumen profesional,objetivo laboral,experiencia laboral,experiencia profesional,trayectoria laboral,formacion academica,"
    "estudios realizados,nivel educativo,habilidades,competencias,idiomas,referencias personales,certificaciones,nombre completo,apellidos,cedula,documento de identidad,identificacion,telefono,celular,movil,whatsapp,"
    "correo electronico,direccion de residencia,ciudad de residencia,domicilio,nacionalidad,estado civil,fecha de nacimiento,lugar de nacimiento,aspiracion salarial,disponibilidad,salario,sueldo,empresa,cargo,experiencia,formacion,educacion"
)
SQL_SCORES = rf"""t AS (SELECT doc_id, coalesce(text, '') AS text FROM {ALL_TEXTS}),
f AS (SELECT doc_id, text, trim(regexp_replace({FOLDED}, '\s+', ' ', 'g')) AS folded,
  list_concat(regexp_extract_all(text, '\b\d{{3}}[\s.-]?\d{{3}}[\s.-]?\d{{4}}\b'), regexp_extract_all(text, '\b\d{{1,3}}(?:[.\s]\d{{3}}){{2,}}\b'), regexp_extract_all(text, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b'), regexp_extract_all(text, '\$\s*\d{{1,3}}(?:[.,]\d{{3}})+')) AS shared,
  list_concat(regexp_extract_all(text, '[\w.+-]+@[\w.-]+\.\w{{2,}}'), regexp_extract_all(text, '(?i)\b\d{{1,2}}\s+(?:de\s+)?(?:{SQL_MONTHS})\s+(?:de\s+)?\d{{4}}\b')) AS own,
  list_concat(regexp_extract_all(text, '[\w.+-]+@[\w.-]+\s*\.\s*\w{{2,}}'), regexp_extract_all(text, '(?i)\b\d{{1,2}}\s+(?:de\s+)?(?:{SQL_MONTHS})\s*(?:de\s+)?\d{{4}}\b'), regexp_extract_all(text, '(?i)\b(?:C\.?C\.?|CC|CO)\s*\d{{6,10}}\b')) AS other FROM t),
scores AS (SELECT doc_id, text, len(list_filter(string_split('{SQL_WORDS}', ','), lambda w: contains(folded, w))) AS coverage,
  len(list_distinct(list_transform(list_concat(shared, own), lambda x: regexp_replace(x, '\s+', '', 'g')))) AS form_data, len(list_distinct(list_transform(list_concat(shared, other), lambda x: regexp_replace(x, '\s+', '', 'g')))) AS data FROM f)"""


@C.add(rf"""WITH {SQL_SCORES}, l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != '') AS lines FROM t)
SELECT doc_id, coverage, data, 2 * form_data + coverage AS form_points, length(trim(text)) * CAST(0.9 AS DOUBLE) AS points, length(trim(text)) >= 400 AS solid,
  len(lines) > 0 AND len(list_filter(lines, lambda y: regexp_matches(y, '^[^:\n]{{2,35}}:(?:\s*$|\s+\S)'))) >= 0.15 * len(lines) AS labelled_table FROM scores JOIN l USING (doc_id)""")
def reading_scores(spark: SparkSession, d: str) -> DataFrame:
    x, sure = F.coalesce("text", F.lit("")), F.lit(0.8)
    return texts(spark, d).select(
        "doc_id", readings.coverage(x).alias("coverage"), readings.distinct_data(x, readings.READING_DATA).alias("data"), readings.form_points(x).alias("form_points"), readings.reading_points(x, sure).alias("points"),
        readings.is_solid(x, sure).alias("solid"), readings.is_labelled_table(x).alias("labelled_table"),
    )


@C.add(f"""WITH {SQL_SCORES}, r AS (SELECT coalesce(source, 'inventado') AS page, s.doc_id, data, 2 * form_data + coverage AS form, length(trim(s.text)) * (0.5 + abs(s.doc_id) % 101 / 100.0 / 2) AS points FROM scores s LEFT JOIN documents o ON o.doc_id = s.doc_id)
SELECT page, first(doc_id ORDER BY data DESC, points DESC, doc_id) AS by_data, first(doc_id ORDER BY form DESC, points DESC, doc_id) AS by_form FROM r GROUP BY page""")
def best_readings(spark: SparkSession, d: str) -> DataFrame:
    given = views.read(spark, d, "documents").select("doc_id", "source")
    rows = texts(spark, d).join(given, "doc_id", "left")
    sure = F.abs(F.col("doc_id")) % 101 / 100
    return dossier.best_readings(rows.select(F.coalesce("source", F.lit("inventado")).alias("page"), F.col("doc_id").alias("reading"), F.coalesce("text", F.lit("")).alias("text"), sure.alias("confidence")))


#: Records of folders, as expressions that both engines read, over doc_id, text, lang, source, n_chars.
RECORD = {
    "folder": "source", "file": "doc_id", "text": "text", "detected": "CASE abs(doc_id) % 4 WHEN 0 THEN 'cv' WHEN 1 THEN 'contract' WHEN 2 THEN 'unknown' ELSE 'liquidacion' END",
    "position": "CASE WHEN abs(doc_id) % 4 IN (1, 3) AND n_chars % 5 < 2 THEN 'cargo ' || lang END", "salary": "CASE WHEN abs(doc_id) % 4 = 1 AND n_chars % 3 > 0 THEN CAST(n_chars AS STRING) END",
    "subject": "CASE WHEN n_chars % 11 = 0 THEN 'asunto ' || lang END", "id_number": "CASE WHEN n_chars % 13 = 0 THEN CAST(10000000 + n_chars AS STRING) WHEN n_chars % 7 = 0 THEN '' END", "eps": "CASE WHEN n_chars % 6 = 0 THEN 'eps ' || CAST(n_chars % 17 AS STRING) END",
    "memo_name": "CASE WHEN n_chars % 9 = 0 THEN substr('Ana Maria Prueba Ensayo', 1, CAST(4 + n_chars % 20 AS INT)) END",
}
CANDIDATE = {
    "first_names": "CASE WHEN n_chars % 5 > 0 THEN 'Ana' ELSE '' END", "last_names": "CASE WHEN n_chars % 4 > 0 THEN 'Prueba ' || lang END", "document_number": "CASE WHEN n_chars % 3 = 0 THEN CAST(20000000 + n_chars AS STRING) END", "phone": "CASE WHEN n_chars % 2 = 0 THEN '3005550000' END",
    "email": "CASE WHEN n_chars % 7 < 2 THEN 'ana@example.org' END", "birth_date": "CASE WHEN n_chars % 8 = 0 THEN '1990-01-01' END", "city": "CASE WHEN n_chars % 10 < 3 THEN 'Cali' END", "headline": "CASE WHEN n_chars % 10 > 2 THEN 'perfil ' || lang END",
}
LISTS = {"experience": "CASE WHEN n_chars % 4 = 1 THEN 'trabajo ' || CAST(n_chars % 7 AS STRING) END", "education": "CASE WHEN n_chars % 6 = 1 THEN 'estudio ' || CAST(n_chars % 5 AS STRING) END"}
PARTS = ("contract", "candidate", "health", "id_card", "settlement", "text")
PERSON = {f"{p}_number": f"CASE WHEN n_chars % {3 + 2 * i} = 0 THEN CAST({i} * 10000000 + n_chars AS STRING) END" for i, p in enumerate(PARTS)} | {f"{p}_name": f"CASE WHEN n_chars % {4 + i} = 1 THEN '{p} ' || lang WHEN n_chars % 2 = 0 THEN '' END" for i, p in enumerate(PARTS)}
BASE_SQL = f"base AS (SELECT doc_id, text, lang, source, n_chars FROM documents UNION ALL SELECT -doc_id, text, 'es', 'inventado', length(text) FROM {corpus.TEXTS_SQL})"


def listing(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


RECORDS_SQL = f"{BASE_SQL}, r AS (SELECT {listing(RECORD | CANDIDATE | LISTS)}, abs(doc_id) % 4 = 0 AS is_cv FROM base)"


def base(spark: SparkSession, d: str) -> DataFrame:
    mine = corpus.texts(spark).select((-F.col("doc_id")).cast("long"), "text", F.lit("es"), F.lit("inventado"), F.length("text").cast("long"))
    return views.read(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").union(mine)


def records(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """The records, with the candidate of those that are CVs (every: of all) as one column."""
    candidate = F.struct(*[F.expr(e).alias(n) for n, e in CANDIDATE.items()], *[F.array_compact(F.array(F.expr(e))).alias(n) for n, e in LISTS.items()])
    return base(spark, d).select(*[F.expr(e).alias(n) for n, e in RECORD.items()], F.when(F.lit(every) | (F.col("doc_id") % 4 == 0), candidate).alias("candidate"))


INDEXED = next(s for s in C.sql["document_kinds"].split("AS loose,\n") if s.startswith("  CASE")).split(" AS indexed")[0]


@C.add(f"""WITH {RECORDS_SQL}, p AS (SELECT *, lower(coalesce(text, '')) AS low, (coalesce(first_names, '') != '')::INT + (coalesce(last_names, '') != '')::INT + 2 * (coalesce(document_number, '') != '')::INT + (coalesce(phone, '') != '')::INT + (coalesce(city, '') != '')::INT AS points FROM r),
h AS (SELECT *, {INDEXED} AS kind FROM p),
best AS (SELECT folder, document_number, headline FROM h WHERE is_cv AND points > 0 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY points DESC, file) = 1),
said AS (SELECT folder, subject AS x FROM h WHERE subject != '' UNION SELECT folder, kind FROM h WHERE detected != 'cv' AND kind IS NOT NULL),
line AS (SELECT folder, string_agg(x, '|' ORDER BY x) AS history FROM said GROUP BY 1),
g AS (SELECT folder, count(*) AS documents, count(*) FILTER (WHERE detected = 'contract') AS contracts, count(*) FILTER (WHERE detected = 'cv') AS cvs, first(id_number ORDER BY file) FILTER (WHERE id_number != '') AS id_number,
  first(position ORDER BY file) FILTER (WHERE position != '') AS position, first(salary ORDER BY file) FILTER (WHERE salary != '') AS salary FROM h GROUP BY folder)
SELECT folder, documents, contracts, cvs, coalesce(id_number, document_number) AS document_number, coalesce(position, headline) AS job, salary, coalesce(history, '') AS history FROM g LEFT JOIN best USING (folder) LEFT JOIN line USING (folder)""")
def person_index(spark: SparkSession, d: str) -> DataFrame:
    return dossier.person_index(records(spark, d)).withColumn("history", F.array_join("history", "|"))


@C.add(f"""WITH {RECORDS_SQL}, p AS (SELECT *, CASE WHEN coalesce(first_names, '') != '' AND coalesce(last_names, '') != '' THEN 5 ELSE 0 END + 3 * (coalesce(document_number, '') != '')::INT + 2 * (coalesce(phone, '') != '')::INT + 2 * (coalesce(email, '') != '')::INT
  + (coalesce(birth_date, '') != '')::INT + 2 * (experience IS NOT NULL)::INT + 2 * (education IS NOT NULL)::INT AS points FROM r),
best AS (SELECT folder, trim(concat_ws(' ', first_names, last_names)) AS name FROM p WHERE is_cv AND points > 0 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY points DESC, file) = 1),
g AS (SELECT folder, max(points) FILTER (WHERE is_cv) AS points, list_sort(list_distinct(list(experience) FILTER (WHERE is_cv AND experience IS NOT NULL))) AS experience, list_sort(list_distinct(list(education) FILTER (WHERE is_cv AND education IS NOT NULL))) AS education,
  last(eps ORDER BY file) FILTER (WHERE eps IS NOT NULL) AS eps, first(memo_name ORDER BY length(memo_name) DESC, file) FILTER (WHERE memo_name IS NOT NULL) AS memo_name FROM p GROUP BY folder)
SELECT folder, CASE WHEN name != '' THEN name END AS name, coalesce(points, 0) AS points, coalesce(array_to_string(experience, '|'), '') AS experience, coalesce(array_to_string(education, '|'), '') AS education, eps, coalesce(memo_name, folder) AS worker_name
FROM g LEFT JOIN best USING (folder)""")
def person_sheet(spark: SparkSession, d: str) -> DataFrame:
    found = dossier.person_sheet(records(spark, d))
    return found.withColumns({c: F.array_join(c, "|") for c in ("experience", "education")})


@C.add(f"""WITH {BASE_SQL}, p AS (SELECT doc_id, {listing(PERSON)} FROM base), n AS (SELECT doc_id, {', '.join(f"nullif({c}, '') AS {c}" for c in PERSON)} FROM p)
SELECT doc_id,
  CASE WHEN contract_number IS NOT NULL OR contract_name IS NOT NULL THEN contract_number WHEN candidate_number IS NOT NULL OR candidate_name IS NOT NULL THEN candidate_number WHEN health_number IS NOT NULL OR health_name IS NOT NULL THEN health_number
    WHEN id_card_number IS NOT NULL OR id_card_name IS NOT NULL THEN id_card_number ELSE text_number END AS batch_number,
  CASE WHEN contract_number IS NOT NULL OR contract_name IS NOT NULL THEN contract_name WHEN candidate_number IS NOT NULL OR candidate_name IS NOT NULL THEN candidate_name WHEN health_number IS NOT NULL OR health_name IS NOT NULL THEN health_name
    WHEN id_card_number IS NOT NULL OR id_card_name IS NOT NULL THEN id_card_name ELSE text_name END AS batch_name,
  CASE WHEN contract_name IS NOT NULL THEN contract_number WHEN health_number IS NOT NULL OR health_name IS NOT NULL THEN health_number WHEN candidate_number IS NOT NULL THEN candidate_number ELSE text_number END AS file_number,
  CASE WHEN contract_name IS NOT NULL THEN contract_name WHEN health_number IS NOT NULL OR health_name IS NOT NULL THEN health_name WHEN candidate_number IS NOT NULL THEN candidate_name END AS file_name,
  coalesce(candidate_number, contract_number, id_card_number, health_number, settlement_number, text_number) AS history_number FROM n""")
def record_identities(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d).select("doc_id", *[F.expr(e).alias(n) for n, e in PERSON.items()])
    batch, file, past = (dossier.identity(x) for x in ("batch", "file", "history"))
    return rows.select("doc_id", batch["number"].alias("batch_number"), batch["name"].alias("batch_name"), file["number"].alias("file_number"), file["name"].alias("file_name"), past["number"].alias("history_number"))


@C.add(rf"""WITH {BASE_SQL}, m AS (SELECT source AS folder, regexp_replace(unnest(regexp_extract_all(text, '(?im)(?:C[.:]?\s*C\s*[.:]?\s*|CEDULA\s*DE\s*CIUDADANIA|^CC\b)\s*[:.]?\s*([1-9][0-9 .,]{{6,14}}[0-9])', 1)), '[^0-9]', '', 'g') AS number FROM base),
c AS (SELECT folder, number, count(*) AS n FROM m WHERE length(number) BETWEEN 7 AND 10 GROUP BY 1, 2) SELECT folder, first(number ORDER BY n DESC, length(number), number) AS number FROM c GROUP BY folder""")
def most_cited_numbers(spark: SparkSession, d: str) -> DataFrame:
    return dossier.most_cited_number(base(spark, d).select(F.col("source").alias("folder"), "text"))


@C.add(r"""WITH j AS (SELECT o_custkey AS person, o_orderkey AS pos, trim(o_orderpriority) AS position, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 9999 ELSE coalesce(TRY_CAST(regexp_extract(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' marzo', '\b(?:19|20)[0-9]{2}\b') AS INT), 0) END AS score FROM orders)
SELECT person, position FROM j WHERE length(position) > 2 QUALIFY row_number() OVER (PARTITION BY person ORDER BY score DESC, pos) = 1""")
def latest_jobs(spark: SparkSession, d: str) -> DataFrame:
    current = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200_000)
    return dossier.latest_job(views.read(spark, d, "orders").select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("position"), current.alias("is_current"), F.lit("marzo").alias("start_date"), F.col("o_orderdate").cast("date").cast("string").alias("end_date")
    ))


@C.add(f"""{views.with_views('employees', 'contracts')} SELECT e.id, min(start_date) AS hired FROM employees e JOIN contracts c ON regexp_replace(e.document_number, '[ .]', '', 'g') = replace(c.worker_document_number, '-', '') GROUP BY e.id""")
def hire_dates(spark: SparkSession, d: str) -> DataFrame:
    signed = views.contracts(spark, d).withColumn("worker_document_number", F.replace("worker_document_number", F.lit("-"), F.lit(" ")))
    return dossier.hire_date(views.employees(spark, d), signed)


@C.add(f"""{views.with_views('employees', 'contracts', 'settlements', 'memoranda')},
c AS (SELECT employee_id, count(*) AS n, bool_or(status != 'terminado') AS active FROM contracts WHERE employee_id IS NOT NULL GROUP BY 1), s AS (SELECT employee_id, max(exit_date) AS exit_date FROM settlements WHERE employee_id IS NOT NULL GROUP BY 1),
m AS (SELECT employee_id, count(*) AS n FROM memoranda WHERE employee_id IS NOT NULL GROUP BY 1)
SELECT e.id, concat_ws('|', CASE WHEN e.status = 'inactivo' AND s.exit_date IS NULL THEN 'sin_fecha_salida' END, CASE WHEN e.status = 'inactivo' AND e.balance >= -500 THEN 'sin_razon_salida' END,
  CASE WHEN e.status = 'activo' AND NOT coalesce(c.active, false) AND coalesce(c.n, 0) = 0 THEN 'sin_contrato_vigente' END, CASE WHEN coalesce(m.n, 0) >= 3 THEN 'tres_memorandos' END, CASE WHEN e.status = 'activo' AND coalesce(c.n, 0) = 0 THEN 'sin_contratos' END) AS notices,
  CASE WHEN e.balance < -500 THEN 'Jubilacion' WHEN e.balance > 9000 THEN 'traslado' END AS reason
FROM employees e LEFT JOIN c ON c.employee_id = e.id LEFT JOIN s ON s.employee_id = e.id LEFT JOIN m ON m.employee_id = e.id""")
def history_notices(spark: SparkSession, d: str) -> DataFrame:
    people = views.employees(spark, d)
    of = lambda rows, *aggregates: rows.where("employee_id IS NOT NULL").groupBy(F.col("employee_id").alias("id")).agg(*aggregates)
    signed = of(views.contracts(spark, d), F.count("*").alias("n_contracts"), F.bool_or(F.col("status") != "terminado").alias("active_contract"))
    left = of(views.settlements(spark, d), F.max("exit_date").cast("string").alias("exit_date"))
    memos = of(views.memoranda(spark, d), F.count("*").alias("n_memos"))
    code = F.when(F.col("balance") < -500, "jubilacion").when(F.col("balance") > 9000, "traslado")
    rows = people.join(signed, "id", "left").join(left, "id", "left").join(memos, "id", "left").fillna(0, ["n_contracts", "n_memos"])
    rows = rows.withColumn("exit_reason", F.when(F.col("balance") < -500, "jubilacion"))
    labels = people.select("id", evidence.reason_label(code).alias("reason"))
    return dossier.notices(rows).withColumn("notices", F.array_join("notices", "|")).join(labels, "id")


@C.add("SELECT c_custkey AS id, coalesce(s_name, c_name) AS name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS balance, c_mktsegment AS area FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def manual_corrections(spark: SparkSession, d: str) -> DataFrame:
    rows = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("area"))
    given = views.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return dossier.corrected(rows, given, "id")


@C.add("""WITH last AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'en_revision' WHEN 'purchase' THEN 'archivado' WHEN 'error' THEN 'terminado' END AS state FROM events WHERE event_type IN ('view', 'purchase', 'error') AND user_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT c_custkey AS id, coalesce(last.state, 'pendiente') AS state FROM customer LEFT JOIN last ON user_id = c_custkey""")
def states_after_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("pendiente").alias("state"))
    done = views.read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return dossier.after_actions(rows, done, {"view": "en_revision", "purchase": "archivado", "error": "terminado"})


KNOWN = "('lector', 'candidatos', 'empleados', 'expediente', 'contratos', 'vacantes', 'memorandos', 'liquidaciones', 'alertas', 'dashboard', 'reportes', 'configuracion')"


@C.add(f"""WITH r AS (SELECT c_custkey AS id, lower(c_mktsegment) AS path, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS v FROM customer UNION ALL SELECT -n_nationkey - 1, (list_value('memorandos', 'reportes', 'nada'))[1 + n_regionkey % 3], n_name FROM nation),
s AS (SELECT id, CASE WHEN path IN {KNOWN} THEN path ELSE 'lector' END AS section, v FROM r)
SELECT id, '#/' || section || CASE WHEN v != '' THEN '?empleado=' || replace(url_encode(v), '%20', '+') ELSE '' END AS link, section, nullif(v, '') AS employee FROM s""")
def route_links(spark: SparkSession, d: str) -> DataFrame:
    people = views.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("path"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("v"))
    path = F.element_at(F.array(*map(F.lit, ("memorandos", "reportes", "nada"))), (1 + F.col("n_regionkey") % 3).cast("int"))
    more = views.read(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long"), path, "n_name")
    links = people.union(more).select("id", dossier.route(F.col("path"), "empleado", F.col("v")).alias("link"))
    parts = dossier.route_parts(F.col("link"))
    return links.select("id", "link", parts["section"].alias("section"), parts["params"]["empleado"].alias("employee"))


@C.add(f"""{views.with_views('employees', 'contracts')}, gone AS (SELECT id FROM employees WHERE status = 'inactivo')
SELECT 'cascade' AS action, count(*) AS n, count(employee_id) AS linked FROM contracts WHERE employee_id IS NULL OR employee_id IN (SELECT id FROM employees WHERE status = 'activo')
UNION ALL SELECT 'set null', count(*), count(*) FILTER (WHERE employee_id IN (SELECT id FROM employees WHERE status = 'activo')) FROM contracts""")
def referential_actions(spark: SparkSession, d: str) -> DataFrame:
    left = views.employees(spark, d).where("status = 'activo'")
    counted = lambda a: dossier.orphans(views.contracts(spark, d), left, "employee_id", a).agg(F.lit(a).alias("action"), F.count("*").alias("n"), F.count("employee_id").alias("linked"))
    return counted("cascade").unionByName(counted("set null")).select("action", "n", "linked")


@C.add(f"""WITH {RECORDS_SQL} SELECT file, coalesce(first_names, '') != '' AND coalesce(last_names, '') != '' AND (coalesce(email, '') != '' OR coalesce(phone, '') != '' OR coalesce(document_number, '') != '' OR experience IS NOT NULL OR education IS NOT NULL) AS is_cv,
  len(list_filter(string_split(concat_ws(' ', first_names, last_names), ' '), lambda w: w != '')) >= 2 AND (coalesce(document_number, '') != '' OR coalesce(email, '') != '' OR coalesce(phone, '') != '' OR coalesce(headline, '') != '') AS is_person,
  salary IS NOT NULL OR coalesce(subject, '') != '' AS has_values FROM r""")
def cv_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, every=True)
    c = lambda f: F.col("candidate")[f]
    sizes = [F.size(c(f)) for f in ("experience", "education")]
    return rows.select(
        "file", evidence.is_cv(c("first_names"), c("last_names"), [c("email"), c("phone"), c("document_number")], *sizes).alias("is_cv"),
        evidence.is_real_person(c("first_names"), c("last_names"), [c("document_number"), c("email"), c("phone"), c("headline")]).alias("is_person"),
        evidence.settlement_has_values([F.col("salary").cast("double")], F.lit(None).cast("string"), F.lit(None).cast("int"), F.array_compact(F.array("subject", F.lit("Fecha de ingreso")))).alias("has_values"),
    )
