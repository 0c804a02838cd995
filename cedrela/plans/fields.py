"""Shapes of values and fields by labels, over the whole documents table; invented texts are further rows, with negative
numbers. The SQL spells every rule out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import dates, dictionaries, shapes
from ..operators import labels, lines
from . import Catalogue, corpus
from .whole import listed, texts

C = Catalogue()

VALUES = [
    "Trabajador: 15 días. Empleador: 30 días", "30 dias", "Aviso  de terminación", "20 horas", "Cra 4 # 5-60", "avenida 3", "Carreras Ana", "Textiles S.A.S", "Pan Ltda.", "Salas", "Atentamente, gerencia", "Hoja de  vida", "Contrato de trabajo",
    "firma del trabajador", "salario: $ 1.500.000", "sueldo mensual de 99", "honorarios: 250000", "NIT No. 900.123.456-7", "RUT 12", "soy Ana Prueba, cc 12345678 tel 3105550000 A@B.co", "Ángela Muestra", "", None, "C1", "intermedio",
]
FORMS = {
    301: "CONTRATO\nEmpleador: Industrias Ejemplo SAS\nNIT: 900.123.456-7\nCorreo: jefe@firma.co\nTrabajador:\nMARTHA CAICEDO RUIZ\nIdentificacion: C.C. 1.098.765.432\nCorreo: marta@correo.co\nFecha de inicio\n01/02/2024\nCARGO\nAuxiliar de aseo\nSALARIOO: $ 1.500.000",
    302: "Cargo: A\nEmpresa: X\nPeriodo: 2018 - 2020\nEmpresa: Y   Cargo: B\nFecha: 2021 a actualidad\nNivel: tecnico\nTitulo: T 2010\nNivel: bachiller\nColegio: C 2005\nUniversidad: U",
    303: "Nombre: Ana María Prueba\nNombre: Otra Persona\nCédula: 12.345.678\nCel: 3105550000\nCorreo: A@b.co\nCorreo: c@d.co\nEstado civil: soltera\nDireccion: Calle 4, Norte\nReferencias\nLuis Ensayo 3105550101 l@e.co",
    304: "Empleador\nTextiles Prueba\nEMPLFADOR: Otro\nTrabajador: Pedro Muestra\nCargo del empleado: Operario\nCargo: Jefe",
    305: "",
    306: None,
}

PLAIN = "translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"
FOLD = f"trim(regexp_replace({PLAIN}, '\\s+', ' ', 'g'))"
ALL_VALUES = f"(SELECT doc_id AS id, text AS x FROM documents UNION ALL SELECT -1 - id, x FROM {corpus.listed_sql(VALUES)}) v"
ALL_FORMS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {corpus.sql_values(list(FORMS.items()), 'doc_id, text')}) v"


def forms(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, spark.createDataFrame(list(FORMS.items()), "doc_id int, text string"))


@C.add(rf"""WITH t AS (SELECT id, x, {FOLD.format('x')} AS f FROM {ALL_VALUES})
SELECT id, (regexp_matches(f, 'dias|meses') AND regexp_matches(f, 'empleador|trabajador|^[0-9]+\s*dias\b|\b(?:15|30)\s*dias\b')) OR regexp_matches(f, '\b(?:aviso|iso)\s+de\s+terminacion\b') AS notice,
  contains(x, '#') OR regexp_matches(f, '^(?:cl|cll|calle|cra|kra|carrera|av|avenida|dg|diagonal|tv|transversal|mz|manzana)\b') AS address,
  regexp_matches(f, '\b(?:s\.?a\.?s\.?|ltda\.?|s\.?a\.?|e\.u\.|s\.?c\.?a\.?|empresa unipersonal)(?:$|[^a-z0-9])') AS firm,
  CASE WHEN regexp_matches(f, '\b(?:atentamente|cordialmente|cordial saludo|firm[ao]|gerencia|direccion general|recursos humanos|talento humano|departamento de personal|administracion)\b|firma del? (?:empleado|trabajador|personal)|recibio|recibido por|responsable de talento') THEN 'firma'
    WHEN regexp_matches(f, '\b(?:curriculum|hoja de vida|curriculo|datos personales|experiencia laboral|perfil profesional|formacion academica|referencias (?:personales|laborales))\b') THEN 'hoja_de_vida'
    WHEN regexp_matches(f, '\b(?:contrato de trabajo|empleador|trabajador|clausul|termino fijo|periodo de prueba|salario|nomina)\b') THEN 'contrato' ELSE 'otro' END AS caption FROM t""")
def value_shapes(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return listed(spark, d, VALUES).select("id", shapes.is_notice(x).alias("notice"), shapes.is_address(x).alias("address"), shapes.is_firm(x).alias("firm"), shapes.caption_kind(x).alias("caption"))


@C.add(rf"""WITH t AS (SELECT id, x, regexp_replace(regexp_extract({PLAIN.format('x')}, '(?:salario|sueldo|remuneracion|asalario|honorarios|ingresos|pago)(?:\s+(?:mensual|basico|esperado|devengado|aspirado|integral))?\s*(?:[:#.-]|\$|de\s+un\s+|por\s+un\s+|de\s+)\s*\$?\s*([0-9][0-9.,]{{4,14}})\b', 1), '[^0-9]', '', 'g') AS n,
  '(?:^|[^\p{{L}}\p{{N}}_])([A-ZÁÉÍÓÚ][a-záéíóú]{{2,}})\s+([A-ZÁÉÍÓÚ][a-záéíóú]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])' AS p FROM {ALL_VALUES})
SELECT id, CASE WHEN length(n) BETWEEN 1 AND 11 AND n::BIGINT BETWEEN 200000 AND 99000000 THEN n::BIGINT END AS pay, nullif(regexp_replace(regexp_extract(x, '(?i)(?:nit|rut)\s*(?:no\.?|n[o°]\.?)?\s*([0-9][0-9.\s-]*[0-9])', 1), '\s+', ' ', 'g'), '') AS tax_id,
  nullif(regexp_extract(x, '(?:^|[^\p{{L}}\p{{N}}_])([A-ZÁÉÍÓÚ][a-záéíóú]{{2,}})\s+([A-ZÁÉÍÓÚ][a-záéíóú]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS first_names,
  nullif(regexp_extract(x, '(?:^|[^\p{{L}}\p{{N}}_])([A-ZÁÉÍÓÚ][a-záéíóú]{{2,}})\s+([A-ZÁÉÍÓÚ][a-záéíóú]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])', 2), '') AS last_names,
  nullif(regexp_extract(x, '\b([0-9]{{7,10}})\b', 1), '') AS document_number, nullif(regexp_extract(x, '\b(3[0-9]{{9}})\b', 1), '') AS phone, nullif(lower(regexp_extract(x, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{{2,}}')), '') AS email FROM t""")
def value_extracts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    found = listed(spark, d, VALUES).select("id", shapes.pay_in(x).alias("pay"), shapes.tax_id_in(x).alias("tax_id"), shapes.by_shape(x).alias("s"))
    return found.select("id", "pay", "tax_id", "s.*")


LINES = rf"""line AS (SELECT doc_id, pos, trim(x) AS text FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {ALL_FORMS})) WHERE trim(x) != '')"""
PAIRS = rf"""part AS (SELECT doc_id, pos, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS nth FROM (SELECT doc_id, pos, list_filter(string_split_regex(regexp_replace(text, '[A-Za-z]+://\S*', '', 'g'), '\s{{2,}}|\||•'), lambda x: regexp_matches(x, '^[^:]{{2,40}}:')) AS p FROM line)),
pair AS (SELECT doc_id, pos, nth, {FOLD.format("split_part(part, ':', 1)")} AS label, trim(regexp_replace(part, '^[^:]*:', '')) AS value FROM part)"""
LABELS = {"employer": ["empleador", "empresa"], "worker": ["trabajador", "empleado"], "email": ["correo"], "position": ["cargo"], "pay": ["salario", "sueldo"]}
LABEL_ROWS = corpus.sql_values([(f, x) for f, names in LABELS.items() for x in names], "field, want")
USABLE = r"length({0}) BETWEEN 2 AND 90 AND NOT regexp_matches({0}, '[:;]\s*$') AND NOT regexp_matches({0}, '^[^:]{{2,40}}:\s*\S') AND len(list_filter(string_split_regex({0}, '\s+'), lambda w: w != '')) <= 12"


@C.add(rf"""WITH {LINES}, near AS (SELECT doc_id, pos, text, lead(text, 1) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cut AS (SELECT *, list_filter(string_split_regex(regexp_replace(text, '[A-Za-z]+://\S*', '', 'g'), '\s{{2,}}|\||•'), lambda x: regexp_matches(x, '^[^:]{{2,40}}:\s*\S')) AS p,
  CASE WHEN {USABLE.format('n1')} THEN n1 WHEN {USABLE.format('n2')} THEN n2 END AS below FROM near),
part AS (SELECT doc_id, pos, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS nth FROM cut),
head AS (SELECT doc_id, pos, {FOLD.format(r"regexp_replace(trim(regexp_replace(regexp_replace(text, '^[\s•●▪◦*·–—-]+', ''), '^[0-9]{1,2}[.)]\s*', '')), '\s*[:.]$', '')")} AS label, below FROM cut WHERE len(p) = 0 AND below IS NOT NULL),
cand AS (SELECT doc_id, pos, nth, {FOLD.format("split_part(part, ':', 1)")} AS label, trim(regexp_replace(part, '^[^:]*:', '')) AS value, FALSE AS alone FROM part
  UNION ALL SELECT doc_id, pos, 0, label, below, TRUE FROM head WHERE length(label) >= 3 AND len(list_filter(string_split(label, ' '), lambda w: w != '')) <= 4),
met AS (SELECT doc_id, field, pos, nth, value, min(CASE WHEN label = want AND NOT alone THEN 0 WHEN NOT alone AND (starts_with(label, want || ' ') OR ends_with(label, ' ' || want)) THEN 1 WHEN label = want THEN 2
    WHEN 1 - levenshtein(label, want) / greatest(length(label), length(want)) >= 0.78 THEN CASE WHEN alone THEN 4 ELSE 3 END END) AS rank FROM cand, {LABEL_ROWS} GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY rank, pos, nth) AS n FROM met WHERE rank IS NOT NULL)
SELECT doc_id, {', '.join(f"max(value) FILTER (field = '{f}') AS {f}" for f in LABELS)} FROM best WHERE n = 1 GROUP BY doc_id""")
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    """Fields by exact, partial and misread labels, on the same line or the next ones."""
    rows = lines.of_text(forms(spark, d)).withColumn("scope", F.lit(None).cast("string"))
    return labels.labelled_fields(labels.candidates(rows), LABELS)


@C.add(rf"""WITH {LINES}, {PAIRS}, kept AS (SELECT *, 100000 * pos + nth AS spot, CASE WHEN label IN ('empresa', 'compania', 'entidad', 'organizacion', 'empleador') THEN 'c' WHEN label IN ('cargo', 'puesto', 'posicion', 'rol', 'denominacion del cargo') THEN 'p'
  WHEN label IN ('fecha', 'fechas', 'periodo', 'duracion', 'vinculacion') THEN 'd' WHEN label IN ('funciones', 'responsabilidades', 'logros', 'actividades') THEN 'f' END AS kind FROM pair),
numbered AS (SELECT *, greatest(sum((kind = 'c' AND value != '')::INT) OVER (PARTITION BY doc_id ORDER BY spot), 1) AS record FROM kept WHERE kind IS NOT NULL),
r AS (SELECT doc_id, record, arg_max(value, spot) FILTER (kind = 'c') AS company, arg_max(value, spot) FILTER (kind = 'p') AS position, {PLAIN.format("arg_max(value, spot) FILTER (kind = 'd')")} AS d, arg_max(value, spot) FILTER (kind = 'f') AS duties FROM numbered GROUP BY doc_id, record),
s AS (SELECT *, regexp_extract(d, '{dates.RANGE}', 1) AS a, regexp_extract(d, '{dates.RANGE}', 2) AS b, coalesce(regexp_extract(d, '{dates.RANGE}', 3), '') != '' AS now FROM r WHERE coalesce(company, '') != '' OR coalesce(position, '') != '')
SELECT doc_id, record::INT AS nth, company, position, nullif(a, '') AS start, CASE WHEN now THEN 'Actual' ELSE nullif(b, '') END AS "end", now AS is_current, duties FROM s""")
def job_records_documents(spark: SparkSession, d: str) -> DataFrame:
    return labels.job_records(lines.labelled_pairs(lines.of_text(forms(spark, d))))


@C.add()
def study_records_documents(spark: SparkSession, d: str) -> DataFrame:
    return labels.study_records(lines.labelled_pairs(lines.of_text(forms(spark, d))))


VALUE_OF = {
    "document_number": ("max", "cedula|cc|documento|identificacion", r"replace(regexp_extract(value, '\b[0-9.]{7,12}\b'), '.', '')"), "phone": ("max", "tel|cel|movil|whatsapp", r"regexp_extract(value, '\b3[0-9]{9}\b')"),
    "email": ("max", "correo|email|mail", r"lower(regexp_extract(value, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}'))"), "name": ("min", "nombre", r"CASE WHEN regexp_matches(value, '\S\s+\S') THEN value END"),
    "city": ("min", "ciudad|lugar|municipio", "NULL"), "address": ("min", "direccion|domicilio", "left(trim(regexp_extract(value, '^[^|,;]*')), 80)"), "nationality": ("min", "nacionalidad", "trim(regexp_extract(value, '^[^|,;]*'))"),
    "marital_status": ("min", "estado civil", "trim(regexp_extract(value, '^[^|,;]*'))"), "gender": ("min", "sexo|genero", "trim(regexp_extract(value, '^[^|,;]*'))"),
}


@C.add(rf"""WITH {LINES}, l AS (SELECT doc_id, pos, {FOLD.format(r"regexp_extract(text, '^([^:]{2,40}):\s*(.+)$', 1)")} AS label, trim(regexp_extract(text, '^([^:]{{2,40}}):\s*(.+)$', 2)) AS value FROM line),
k AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(label, '{p}') THEN '{k}'" for k, (_, p, _x) in VALUE_OF.items())} END AS kind FROM l WHERE label != ''),
v AS (SELECT doc_id, pos, kind, nullif(CASE kind {' '.join(f"WHEN '{k}' THEN {x}" for k, (_, _p, x) in VALUE_OF.items())} END, '') AS x FROM k WHERE kind IS NOT NULL),
g AS (SELECT doc_id, {', '.join(f"arg_{a}(x, pos) FILTER (kind = '{k}') AS {k}" for k, (a, _, _x) in VALUE_OF.items() if k != 'city')} FROM v WHERE x IS NOT NULL OR kind = 'city' GROUP BY doc_id)
SELECT * EXCLUDE (name), regexp_replace(name, '\s+\S+$', '') AS first_names, regexp_extract(name, '(\S+)$', 1) AS last_names FROM g WHERE coalesce({', '.join(k for k in VALUE_OF if k != 'city')}) IS NOT NULL""")
def context_fields_documents(spark: SparkSession, d: str) -> DataFrame:
    """Fields of `label: value` lines; the city, which needs the dictionaries, is left to the tests."""
    found = labels.context_fields(lines.of_text(forms(spark, d))).drop("city")
    return found.where(F.coalesce(*[c for c in found.columns if c != "doc_id"]).isNotNull())


@C.add()
def own_email_documents(spark: SparkSession, d: str) -> DataFrame:
    return labels.own_email(lines.of_text(forms(spark, d)))


@C.add()
def header_lines_documents(spark: SparkSession, d: str) -> DataFrame:
    found = lines.sections(lines.of_text(forms(spark, d)), lines.heading_kind(F.col("text")))
    return labels.header_rows(found).select("doc_id", "pos", "text", "section")


@C.add()
def contract_parties_documents(spark: SparkSession, d: str) -> DataFrame:
    return labels.contract_parties(forms(spark, d))


MISREAD = ["small rnig", "red widgett", "blue boltt", "smal gear", "large", "redwidget", "zzzzzzzzz", "", None, "red  widget", "smlal rnig"]
ALL_NAMES = f"(SELECT p_partkey AS id, p_name || ' ' || p_type AS x FROM part UNION ALL SELECT -1 - id, x FROM {corpus.listed_sql(MISREAD)}) v"


@C.add(rf"""WITH v AS (SELECT * FROM {ALL_NAMES}), t AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT p_name || ' ' || reverse(p_type) FROM part UNION SELECT DISTINCT p_name || 's ' || p_type FROM part),
p AS (SELECT x, term, levenshtein(x, term) AS distance FROM (SELECT DISTINCT x FROM v WHERE x != ''), t WHERE levenshtein(x, term) <= 0.18 * greatest(length(x), length(term))),
b AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY distance, term) AS n FROM p) SELECT id, term, distance FROM v JOIN b USING (x) WHERE n = 1""")
def fuzzy_lookup_parts(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of a table of terms for every name of a part, and for some misread names."""
    part = views.read(spark, d, "part")
    rows = part.select(F.col("p_partkey").cast("long").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("x"))
    mine = corpus.listed(spark, MISREAD).select((-1 - F.col("id")).cast("long"), "x")
    terms = part.select(F.explode(F.array("p_name", F.concat_ws(" ", "p_name", F.reverse("p_type")), F.concat(F.col("p_name"), F.lit("s "), F.col("p_type")))).alias("term"))
    return dictionaries.fuzzy_lookup(rows.union(mine), "x", terms)
