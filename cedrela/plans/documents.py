"""Text, dates, amounts, names, classification and form parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import classify, dates, names, numbers, text
from ..operators import parsers
from . import Catalogue, corpus

C = Catalogue()


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def fold_only(x: str) -> str:
    return f"strip_accents(lower({x}))"


def fold(x: str) -> str:
    return f"trim(regexp_replace({fold_only(x)}, '\\s+', ' ', 'g'))"


def get(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(trim(regexp_extract({x}, {quoted(pattern)}, {group})), '')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def ranked(kinds: dict[str, int], x: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({x}, {quoted(k)}) THEN {w} ELSE 0 END" for k, w in kinds.items()) + ")"


def similarity(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END)"


@C.add(f"SELECT doc_id, sha256({fold('text')}) AS folded, length({fold('text')}) AS n FROM documents")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    x = text.fold(F.col("text"))
    return views.read(spark, d, "documents").select("doc_id", F.sha2(x, 256).alias("folded"), F.length(x).alias("n"))


@C.add(f"SELECT doc_id, len(list_filter(string_split_regex({fold_only('text')}, '\\s+'), lambda t: regexp_matches(t, '[a-z0-9]'))) AS n_words FROM documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@C.add("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) != '')) AS n_lines, sha256(upper(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g'))) AS k FROM documents")
def vocabulary_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = views.read(spark, d, "documents")
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return docs.select("doc_id", n.alias("n_lines"), F.sha2(text.vocabulary_key(F.regexp_replace("text", "ß", "")), 256).alias("k"))


PAIRS = "p AS (SELECT a.item_id, b.item_id AS other, regexp_replace(strip_accents(lower(a.text)), '[^a-z ]', '', 'g') AS x, regexp_replace(strip_accents(lower(b.text)), '[^a-z ]', '', 'g') AS y FROM benchmark a JOIN benchmark b ON b.item_id BETWEEN a.item_id + 1 AND a.item_id + 3)"


@C.add(f"WITH {PAIRS} SELECT item_id, other, levenshtein(x, y) AS distance, {similarity('x', 'y')} AS similarity FROM p")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    start = F.regexp_replace(text.fold_only(F.col("text")), "[^a-z ]", "")
    a = views.read(spark, d, "benchmark")
    near = a.select("item_id", F.explode(F.sequence(F.col("item_id") + 1, F.col("item_id") + 3)).alias("other"), start.alias("x"))
    both = near.join(a.select(F.col("item_id").alias("other"), start.alias("y")), "other")
    return both.select("item_id", "other", F.levenshtein("x", "y").alias("distance"), text.similarity(F.col("x"), F.col("y")).alias("similarity"))


@C.add(
    f"""WITH t AS (SELECT id, i, term, {similarity('lower(x)', 'lower(term)')} AS score FROM {corpus.listed_sql(corpus.WORDS)}, {corpus.sql_values(list(enumerate(corpus.LEXICON)), 'i, term').replace(' v(', ' w(')})
SELECT id, CASE WHEN max(score) >= 0.82 THEN arg_max(lower(term), score * 1000 - i / 1000.0) END AS term, CASE WHEN max(score) >= 0.82 THEN max(score) END AS score FROM t GROUP BY id""", aside=True
)
def best_match_dictionary(spark: SparkSession, d: str) -> DataFrame:
    m = text.best_match(F.lower("x"), [t.lower() for t in corpus.LEXICON])
    return corpus.listed(spark, corpus.WORDS).select("id", m["term"].alias("term"), m["score"].alias("score"))


@C.add(f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(text.EMAIL)})) AS email FROM documents")
def find_emails(spark: SparkSession, d: str) -> DataFrame:
    docs = views.read(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0))).alias("email"))


ALL_PHONES = f"regexp_extract_all(regexp_replace(lower(text), {quoted(numbers.YEARS)}, ' ', 'g'), {quoted(numbers.PHONE)})"
PARTED = f"flatten(list_transform({ALL_PHONES}, lambda x: CASE WHEN length({digits('x')}) > 15 THEN string_split_regex(x, '\\s*-\\s*') ELSE [x] END))"
CLEAN_PHONES = f"list_transform({PARTED}, lambda x: trim(regexp_replace(x, '[ .()-]+$', '')))"


@C.add(
    f"""WITH f AS (SELECT doc_id, list_filter({CLEAN_PHONES}, lambda x: length({digits('x')}) BETWEEN 7 AND 15 AND NOT regexp_matches(x, {quoted(numbers.TAX_ID)})) AS p FROM documents)
SELECT doc_id, p[1] AS phone FROM f WHERE len(p) > 0"""
)
def find_phones(spark: SparkSession, d: str) -> DataFrame:
    docs = views.read(spark, d, "documents")
    return docs.select("doc_id", numbers.phone(F.col("text")).alias("phone")).where("phone IS NOT NULL")


def id_sql(x: str) -> str:
    labelled, dotted, bare = digits(get(x, numbers.LABELLED_ID)), digits(get(x, numbers.DOTTED_ID)), get(x, numbers.BARE_ID)
    free = lambda v: f"CASE WHEN NOT starts_with({v}, '3') AND length({v}) BETWEEN 7 AND 11 THEN {v} END"
    return f"coalesce(CASE WHEN length({labelled}) BETWEEN 7 AND 11 THEN {labelled} END, {free(dotted)}, {free(bare)})"


@C.add(f"SELECT conv_id, turn, {id_sql(fold_only('text'))} AS document FROM conversations WHERE {id_sql(fold_only('text'))} IS NOT NULL UNION ALL SELECT id, -1, {id_sql(fold_only('x'))} FROM {corpus.listed_sql(corpus.IDS)}")
def find_ids(spark: SparkSession, d: str) -> DataFrame:
    talk = views.read(spark, d, "conversations").select("conv_id", "turn", numbers.document_in_text(text.fold_only(F.col("text"))).alias("document")).where("document IS NOT NULL")
    mine = corpus.listed(spark, corpus.IDS).select(F.col("id").cast("long"), F.lit(-1).cast("long"), numbers.document_in_text(text.fold_only(F.col("x"))))
    return talk.union(mine)


HITS = " || ".join(f"regexp_extract_all(text, {quoted(p)})" for p in (text.EMAIL, text.PHONE, text.LONG_NUMBER, text.SHORT_DATE))


@C.add(f"SELECT doc_id, len(list_distinct(list_transform({HITS}, lambda x: regexp_replace(x, '\\s', '', 'g')))) AS hits FROM documents")
def form_score(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "documents").select("doc_id", text.data_hits(F.col("text")).alias("hits"))


VOWELLESS = "length(t) > 6 AND NOT regexp_matches(t, '[aeiou]')"
RUN = "list_has_any([x[i:i+3] = repeat(x[i], 4) AND length(x[i:i+3]) = 4 FOR i IN range(1, length(x))], [true])"


@C.add(
    f"""WITH all_docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM {corpus.TEXTS_SQL}),
w AS (SELECT doc_id, text, list_filter(string_split_regex({fold_only('text')}, '\\s+'), lambda t: regexp_matches(t, '[a-z]')) AS tokens, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS lines FROM all_docs),
s AS (SELECT doc_id, text, len(tokens) AS n, len(lines) AS n_lines, len(list_filter(tokens, lambda t: {VOWELLESS})) AS odd, len(list_filter(tokens, lambda t: regexp_matches(t, '[aeiou].*[aeiou]'))) AS voiced,
  len(list_filter(lines, lambda x: {RUN})) AS runs FROM w),
r AS (SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'vacio' WHEN n_lines > 0 AND runs > 0.3 * n_lines THEN 'repeticion' WHEN odd > 3 AND n > 9 THEN 'sin_vocales' WHEN n > 10 AND voiced < 0.25 * n THEN 'pocas_palabras' END AS reason FROM s)
SELECT doc_id, reason IS NOT NULL AS flag, reason FROM r"""
)
def unintelligible_text(spark: SparkSession, d: str) -> DataFrame:
    docs = views.read(spark, d, "documents").select("doc_id", "text").union(corpus.texts(spark).select((-F.col("doc_id")).cast("long"), "text"))
    return docs.select("doc_id", text.unintelligible(F.col("text")).alias("x")).select("doc_id", "x.*")


def number_word(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(w)} THEN {n}" for w, n in dates.DAY_NUMBER.items())
    return f"coalesce(try_cast({x} AS INT), CASE {x} {cases} END)"


def iso_sql(y: str, m: str, d: str) -> str:
    pad = lambda v, n: f"lpad(CAST({v} AS VARCHAR), {n}, '0')"
    return f"strftime(try_cast({pad(y, 4)} || '-' || {pad(m, 2)} || '-' || {pad(d, 2)} AS DATE), '%Y-%m-%d')"


def month_word(x: str) -> str:
    return f"CASE {x} {' '.join(f'WHEN {quoted(w)} THEN {n}' for w, n in dates.MONTH_NUMBER.items())} END"


def full_year(x: str) -> str:
    return f"CASE WHEN length({x}) = 2 THEN '20' || {x} ELSE {x} END"


def textual(x: str) -> str:
    return iso_sql(get(x, dates.TEXTUAL, 3), month_word(get(x, dates.TEXTUAL, 2)), number_word(get(x, dates.TEXTUAL, 1)))


def normal_date(x: str) -> str:
    a, b, c = (get(f"trim({x})", dates.WHOLE, k) for k in (1, 2, 3))
    return f"coalesce({textual(x)}, CASE WHEN length({a}) = 4 THEN {iso_sql(a, b, c)} WHEN length({a}) <= 2 THEN {iso_sql(full_year(c), b, a)} END)"


def repair_year(y: str) -> str:
    one, two = f"(1000 + {y} % 1000)", f"(2000 + {y} % 1000)"
    fits = lambda v: f"{v} BETWEEN 1900 AND 2100"
    return f"CASE WHEN {fits(y)} THEN {y} WHEN {fits(one)} AND NOT {fits(two)} THEN {one} WHEN {fits(two)} AND NOT {fits(one)} THEN {two} END"


def loose_date(x: str) -> str:
    y = [get(x, dates.YEAR_FIRST, k) for k in (1, 2, 3)]
    d = [get(x, dates.DAY_FIRST, k) for k in (1, 2, 3)]
    year = lambda v: repair_year(f"CAST({v} AS INT)")
    return f"coalesce({textual(x)}, {iso_sql(year(y[0]), y[1], y[2])}, {iso_sql(year(f'({full_year(d[2])})'), d[1], d[0])})"


DATES = f"(SELECT id, x, {fold_only('x')} AS f FROM {corpus.listed_sql(corpus.DATES)})"
FIRST = f"{full_year(get('f', dates.DAY_FIRST, 3))}"


@C.add(
    f"""SELECT id, {normal_date('f')} AS form_a, {loose_date('trim(f)')} AS form_b,
(CASE WHEN {get('f', dates.DAY_FIRST, 3)} IS NOT NULL THEN ({FIRST}) || '-' || lpad({get('f', dates.DAY_FIRST, 2)}, 2, '0') || '-' || lpad({get('f', dates.DAY_FIRST, 1)}, 2, '0') END) AS first_in_text,
{get('f', dates.RANGE, 1)} AS range_start, CASE WHEN {get('f', dates.RANGE, 3)} IS NOT NULL THEN 'Actual' ELSE {get('f', dates.RANGE, 2)} END AS range_end FROM {DATES}""", aside=True
)
def text_dates(spark: SparkSession, d: str) -> DataFrame:
    f = text.fold_only(F.col("x"))
    span = dates.date_range(f)
    return corpus.listed(spark, corpus.DATES).select(
        "id", dates.normal_date(f).alias("form_a"), dates.loose_date(f).alias("form_b"), dates.first_date(f).alias("first_in_text"), span["start"].alias("range_start"), span["end"].alias("range_end")
    )


def amount_sql(x: str) -> str:
    n = digits(f"regexp_replace(regexp_replace({x}, '[^0-9.,]', '', 'g'), '[.,][0-9]{{2}}$', '')")
    return f"CASE WHEN length({n}) BETWEEN 4 AND 15 THEN CAST({n} AS BIGINT) END"


SALARY = amount_sql(f"replace({get('f', numbers.SALARY)}, ' ', '')")
EXPECTED = f"CASE WHEN length({digits('x')}) BETWEEN 1 AND 11 AND CAST({digits('x')} AS BIGINT) BETWEEN 200000 AND 99000000 THEN CAST({digits('x')} AS BIGINT) END"


@C.add(f"SELECT id, {amount_sql('x')} AS amount, CASE WHEN ({SALARY}) > 1000 THEN ({SALARY}) END AS salary, {EXPECTED} AS expected FROM (SELECT id, x, {fold_only('x')} AS f FROM {corpus.listed_sql(corpus.AMOUNTS)})", aside=True)
def text_amounts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return corpus.listed(spark, corpus.AMOUNTS).select("id", numbers.amount(x).alias("amount"), numbers.salary(text.fold_only(x)).alias("salary"), numbers.expected_salary(x).alias("expected"))


_W = "list_filter(string_split_regex(trim(regexp_replace(trim(x), {t}, '')), '\\s+'), lambda w: w != '')"


def name_sql(titles: bool) -> str:
    w = _W.format(t=quoted(names.TITLES if titles else "^$"))
    particles = "[" + ", ".join(map(quoted, names.PARTICLES)) + "]"
    at = f"list_position(list_transform({w}, lambda v: list_contains({particles}, lower(v))), true)"
    if titles:
        cut = f"CASE WHEN coalesce({at}, 0) > 1 THEN {at} - 1 WHEN len({w}) <= 1 THEN len({w}) WHEN len({w}) <= 3 THEN 1 ELSE 2 END"
    else:
        cut = f"CASE WHEN len({w}) <= 2 THEN least(len({w}), 1) ELSE 2 END"
    return f"array_to_string({w}[1:({cut})], ' ') AS first_{'a' if titles else 'b'}, array_to_string({w}[({cut}) + 1:], ' ') AS last_{'a' if titles else 'b'}"


@C.add(f"SELECT id, {name_sql(True)}, {name_sql(False)} FROM {corpus.listed_sql(corpus.NAMES)}", aside=True)
def name_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = names.split_name(F.col("x")), names.split_name_plain(F.col("x"))
    return corpus.listed(spark, corpus.NAMES).select("id", a["first_names"].alias("first_a"), a["last_names"].alias("last_a"), b["first_names"].alias("first_b"), b["last_names"].alias("last_b"))


def has(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(x, {quoted(p)})" for p in phrases) + ")"


def like(pattern: str) -> str:
    return f"regexp_matches(x, {quoted(pattern)})"


CLASSES = f"""scored AS (SELECT doc_id, x, {ranked(classify.CV, 'x')} AS cv, {ranked(classify.HEALTH, 'x')} AS health, {ranked(classify.ID_CARD, 'x')} AS card, {ranked(classify.CONTRACT, 'x')} AS contract,
  {ranked(classify.SETTLEMENT, 'x')} + CASE WHEN {like(classify.BONUS)} THEN 3 ELSE 0 END AS settlement, {' + '.join(f'CAST({like(p)} AS INT)' for p in classify.DENSITY)} AS density, {like(classify.AFFILIATED)} AS affiliated FROM folded),
class AS (SELECT doc_id, CASE WHEN cv >= 5 THEN 'hoja_de_vida'
  WHEN {has('certificado de afiliacion')} OR affiliated AND (health >= 4 OR health >= 3 AND {has('arl', 'eps')}) THEN 'salud'
  WHEN card >= 4 AND NOT ({has(*classify.LICENCE)} OR {has('categoria')} AND {has('conduccion', 'conducir')}) THEN 'cedula'
  WHEN {has(*classify.CONTRACT_HEADS)} OR {like(classify.CONTRACT_LINE)} THEN 'contrato'
  WHEN {like(classify.WARNING)} AND NOT {has('historial disciplinario')} OR {has('atencion')} AND {has('para:')} AND {has('asunto:')} THEN 'llamado_atencion'
  WHEN {like(classify.MEMO)} AND NOT {has('historial disciplinario')} OR {has('para:')} AND {has('asunto:')} AND {has('de:', 'memorand')} THEN 'memorando'
  WHEN ({has('carta de renuncia')} OR {like(classify.RESIGNATION)}) AND NOT {has('desvinculacion')} THEN 'renuncia'
  WHEN settlement >= 4 THEN 'liquidacion'
  WHEN contract >= 4 OR contract >= 2 AND cv < 3 AND {has('empleador')} AND {has('trabajad')} THEN 'contrato'
  WHEN {has(*classify.FUNCTIONS)} THEN 'funciones'
  WHEN cv >= 3 OR density >= 3 THEN 'hoja_de_vida' ELSE 'desconocido' END AS category FROM scored)"""


@C.add(f"WITH folded AS (SELECT doc_id, {fold_only('text')} AS x FROM {corpus.TEXTS_SQL} UNION ALL SELECT -1 - doc_id, {fold_only('text')} FROM documents), {CLASSES} SELECT doc_id, category FROM class")
def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    both = corpus.texts(spark).select(F.col("doc_id").cast("long"), "text").union(views.read(spark, d, "documents").select(-1 - F.col("doc_id"), "text"))
    return classify.classified(both).select("doc_id", "category")


@C.add(f"WITH folded AS (SELECT doc_id, {fold_only('text')} AS x FROM {corpus.TEXTS_SQL}), {CLASSES} SELECT CASE category {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in classify.FORM.items())} ELSE 'unknown' END AS form, count(*) AS n FROM class GROUP BY 1", aside=True)
def document_form(spark: SparkSession, d: str) -> DataFrame:
    return corpus.texts(spark).groupBy(classify.form(classify.category(F.col("text"))).alias("form")).agg(F.count("*").alias("n"))


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split_regex(trim({x}), '\\s+'), lambda w: CASE WHEN length(w) > 2 THEN upper(w[1]) || w[2:] ELSE w END), ' ')"


def titled(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {title(x)} END"


FOLDED = f"(SELECT doc_id, text, {fold_only('text')} AS x FROM {corpus.TEXTS_SQL})"


@C.add(
    f"""SELECT doc_id, {digits(f"coalesce({get('x', parsers.ID_NUMBER)}, {get('x', '(?:^|[^0-9])([1-9][0-9]{6,9})(?:$|[^0-9])')})")} AS document_number, {titled(get('x', parsers.FIRST_NAMES))} AS first_names,
{titled(get('x', parsers.LAST_NAMES))} AS last_names, {normal_date(get('x', parsers.BIRTH))} AS birth_date, {titled(get('x', parsers.ISSUED))} AS expedition_place FROM {FOLDED}""", aside=True
)
def parse_id_card(spark: SparkSession, d: str) -> DataFrame:
    return parsers.id_card(corpus.texts(spark))


def known(x: str, terms: list[str]) -> str:
    folded = lambda n: n.lower().translate(str.maketrans("áéíóúñ", "aeioun"))
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?:^|[^a-z0-9]){folded(n)}(?:$|[^a-z0-9])') THEN {quoted(n)}" for n in terms) + " END"


@C.add(
    f"""SELECT doc_id, {known('x', parsers.EPS)} AS eps, CASE WHEN contains(x, 'subsidiado') THEN 'Subsidiado' ELSE 'Contributivo' END AS regime, 'ARL ' || {known('x', parsers.ARL)} AS arl, {known('x', parsers.PENSION)} AS pension,
{known('x', parsers.COMPENSATION)} AS compensation, {titled(get('x', parsers.MEMBER))} AS worker_name, {id_sql('x')} AS document_number FROM {FOLDED}""", aside=True
)
def parse_health(spark: SparkSession, d: str) -> DataFrame:
    return parsers.health(corpus.texts(spark))


def dated(labels: str) -> str:
    return normal_date(get("x", rf"(?:{labels})\s*[:#.-]?\s*([0-9]{{1,4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,4}})"))


def labelled(label: str) -> str:
    found = amount_sql(get("x", rf"(?:{label})\s*[:#.-]?\s*{numbers.AMOUNT}"))
    return f"CASE WHEN ({found}) > 0 THEN ({found}) END"


OTHER = f"""list_filter(list_transform(string_split(x, chr(10)), lambda l: {{'concept': trim(regexp_extract(l, {quoted(parsers.CONCEPT_LINE)}, 1)), 'amount': {amount_sql(f"regexp_extract(l, {quoted(parsers.CONCEPT_LINE)}, 2)")}}}),
  lambda p: p.concept != '' AND NOT regexp_matches(p.concept, {quoted(parsers.NO_CONCEPT)}) AND coalesce(p.amount, 0) > 0)"""


@C.add(
    f"""SELECT doc_id, {titled(get('x', parsers.WORKER))} AS worker_name, {id_sql('x')} AS worker_document_number, {titled(get('x', parsers.EMPLOYER))} AS employer_name, {titled(get('x', parsers.POSITION))} AS position,
{dated('fecha' + chr(92) + 's+de' + chr(92) + 's+ingreso|ingreso')} AS hire_date, {dated('fecha' + chr(92) + 's+de' + chr(92) + 's+(?:retiro|salida|terminacion)|retiro|salida')} AS exit_date, nullif(CAST({get('x', parsers.DAYS)} AS INT), 0) AS days,
{', '.join(f'{labelled(label)} AS {name}' for name, label in parsers.CONCEPTS.items())}, coalesce({', '.join(labelled(t) for t in parsers.TOTALS)}) AS total,
len({OTHER}) AS n_other, coalesce(list_sum(list_transform({OTHER}, lambda p: p.amount)), 0)::BIGINT AS other_amount FROM {FOLDED}""", aside=True
)
def parse_settlement(spark: SparkSession, d: str) -> DataFrame:
    return parsers.settlement(corpus.texts(spark))


def header(label: str) -> str:
    return titled(get("text", rf"(?im)^\s*{label}\s*:\s*([^\n]*[^\s])"))


BODY = "trim(regexp_extract(text, '(?is)asunto\\s*:[^\\n]*\\n(.*)$', 1))"


@C.add(
    f"""SELECT doc_id, {header('para')} AS "to", {header('de')} AS "from", {header('asunto')} AS subject, CASE WHEN contains(x, 'llamado de atencion') THEN 'llamado_atencion' WHEN contains(x, 'amonestacion disciplinaria') THEN 'amonestacion_disciplinaria'
WHEN contains(x, 'amonestaci') THEN 'amonestacion_preventiva' ELSE 'otro' END AS memo_type, coalesce({dated('fecha')}, {textual('x')}) AS memo_date, {id_sql('x')} AS document_number, nullif(substr({BODY}, 1, 2000), '') AS body FROM {FOLDED}""", aside=True
)
def parse_memo(spark: SparkSession, d: str) -> DataFrame:
    return parsers.memo(corpus.texts(spark))


FUNCTIONS = f"""list_filter(list_transform(string_split(text, chr(10)), lambda t: regexp_replace(trim(regexp_extract(t, {quoted(parsers.FUNCTION_LINE)}, 1)), '[.;,\\s]+$', '')),
  lambda t: length(t) >= 4 AND NOT regexp_matches({fold_only('t')}, {quoted(parsers.NO_FUNCTION)}))"""


@C.add(f"SELECT doc_id, {titled(get('x', parsers.POSITION))} AS position, array_to_string(list_transform({FUNCTIONS}, lambda t: {title('t')}), '|') AS functions FROM {FOLDED}", aside=True)
def parse_functions(spark: SparkSession, d: str) -> DataFrame:
    return parsers.job_functions(corpus.texts(spark)).withColumn("functions", F.array_join("functions", "|"))


@C.add(
    f"""SELECT id, CASE WHEN n >= 1 THEN n END AS months, CAST(date_trunc('month', s) + to_months(CAST(id % 7 AS INT)) AS DATE) + (day(s) - 1)::INT AS overflow, CAST(s + to_months(CAST(id % 7 AS INT)) AS DATE) AS clamped
FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) AS e,
  (year(e) - year(s)) * 12 + month(e) - month(s) + CASE WHEN month(e) < month(s) THEN 1 ELSE 0 END AS n FROM orders)"""
)
def months_between(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderdate").cast("date")
    rows = views.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("s"), F.date_add(s, (F.col("o_orderkey") % 900).cast("int")).alias("e"))
    step = (F.col("id") % 7).cast("int")
    return rows.select("id", dates.months_between(F.col("s"), F.col("e")).alias("months"), dates.add_months_overflow(F.col("s"), step).alias("overflow"), F.add_months("s", step).alias("clamped"))


_TERM = f"CAST({get('x', dates.TERM)} AS INT)"


@C.add(f"SELECT doc_id, CASE WHEN {_TERM} BETWEEN 1 AND 120 THEN {_TERM} END AS months FROM {FOLDED}", aside=True)
def term_bounds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.texts(spark).select("doc_id", dates.term_months(text.fold_only(F.col("text"))).alias("months"))


@C.add(
    f"""SELECT doc_id, CASE WHEN n < 40 OR c < 0.4 THEN 'critica' WHEN c < 0.6 THEN 'baja' WHEN c < 0.8 OR n < 200 THEN 'media' ELSE 'alta' END AS level FROM (SELECT doc_id, length(trim(text)) AS n, (doc_id % 100) / 100.0 AS c FROM documents)"""
)
def confidence_levels(spark: SparkSession, d: str) -> DataFrame:
    return views.read(spark, d, "documents").select("doc_id", text.confidence_level((F.col("doc_id") % 100) / 100.0, F.col("text")).alias("level"))
