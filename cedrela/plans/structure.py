"""Lines and sections, dictionaries, accuracy, groups, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import compare, dictionaries, text
from ..operators import accuracy, geometry, grouping, layout, lines
from . import Catalogue, corpus
from .documents import fold, fold_only, like, quoted, similarity

C = Catalogue()

LINES = "line AS (SELECT doc_id, pos, trim(x) AS text FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(x) != '')"
#: In the supplied documents no line is a known heading; there, a line of two words or fewer stands for one.
SHORT = "len(string_split_regex(text, '\\s+')) <= 2"


def short_heading() -> DataFrame:
    return F.when(F.size(F.split("text", r"\s+")) <= 2, F.lower("text"))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.of_text(views.read(spark, d, "documents"))


SECTIONS = f"""{LINES}, h AS (SELECT *, CASE WHEN {SHORT} THEN lower(text) END AS heading FROM line),
section AS (SELECT *, count(heading) OVER w AS section_id, coalesce(last_value(heading IGNORE NULLS) OVER w, 'encabezado') AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@C.add(f"WITH {SECTIONS} SELECT doc_id, section_id, section, count(*) AS n_lines FROM section GROUP BY 1, 2, 3")
def sections_by_heading(spark: SparkSession, d: str) -> DataFrame:
    found = lines.sections(document_lines(spark, d), short_heading())
    return found.groupBy("doc_id", "section_id", "section").agg(F.count("*").alias("n_lines"))


@C.add(f"WITH {SECTIONS} SELECT doc_id, section, count(*) AS n_lines, sha256(string_agg(text, chr(10) ORDER BY pos)) AS text FROM section WHERE heading IS NULL GROUP BY 1, 2")
def section_members(spark: SparkSession, d: str) -> DataFrame:
    out = lines.section_text(lines.sections(document_lines(spark, d), short_heading()))
    return out.withColumn("text", F.sha2("text", 256))


CUE = "contains(text, ',')"


@C.add(
    f"""WITH {LINES} SELECT doc_id, pos, length(last_value(CASE WHEN {CUE} THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS above,
length(first_value(CASE WHEN {CUE} THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS below,
coalesce(lag({CUE}, 1) OVER w, false) OR coalesce(lead({CUE}, 1) OVER w, false) OR coalesce(lag({CUE}, 2) OVER w, false) OR coalesce(lead({CUE}, 2) OVER w, false) AS near
FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""
)
def neighbour_search(spark: SparkSession, d: str) -> DataFrame:
    cue = F.contains("text", F.lit(","))
    value = F.when(cue, F.col("text"))
    return document_lines(spark, d).select("doc_id", "pos", F.length(lines.nearest_above(value, 4)).alias("above"), F.length(lines.nearest_below(value, 3)).alias("below"), lines.any_within(cue, 2).alias("near"))


@C.add(f"WITH {LINES} SELECT doc_id, pos, sha256(text) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {fold('text')} ORDER BY pos) AS nth FROM line) WHERE nth = 1")
def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    keyed = document_lines(spark, d).withColumn("key", text.fold(F.col("text")))
    return lines.keep_first(keyed, ["key"]).select("doc_id", "pos", F.sha2("text", 256).alias("text"))


LABELS = ["nombres", "cargo", "trabajador", "asunto"]
CORPUS_LINES = f"""line AS (SELECT doc_id, pos, trim(x) AS text FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {corpus.TEXTS_SQL})) WHERE trim(x) != '')"""
PART = "{l} || ''"


@C.add(
    f"""WITH {CORPUS_LINES}, part AS (SELECT doc_id, pos, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS nth FROM (SELECT doc_id, pos, list_filter(string_split_regex(text, '\\s{{2,}}|\\||•'), lambda x: regexp_matches(x, '^[^:]{{2,40}}:')) AS p FROM line)),
pair AS (SELECT doc_id, pos, nth, {fold("split_part(part, ':', 1)")} AS label, trim(regexp_replace(part, '^[^:]*:', '')) AS value FROM part),
near AS (SELECT doc_id, pos, lead(text, 1) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT p.doc_id, p.pos, p.nth, CASE WHEN value != '' THEN value WHEN NOT regexp_matches(n1, ':\\s*$') THEN n1 WHEN NOT regexp_matches(n2, ':\\s*$') THEN n2 END AS value,
  CASE WHEN label IN ({', '.join(map(quoted, LABELS))}) THEN 0 WHEN {' OR '.join(f"starts_with(label, '{x} ') OR ends_with(label, ' {x}')" for x in LABELS)} THEN 1 END AS rank FROM pair p LEFT JOIN near n USING (doc_id, pos))
SELECT doc_id, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, pos, nth) AS n FROM r WHERE rank IS NOT NULL AND value IS NOT NULL) WHERE n = 1""", aside=True
)
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lines.label_value(lines.of_text(corpus.texts(spark)), LABELS)


TITLES = ["Auxiliar de aseo", "operario", "Jefe de bodega y operario de producción", "Contadora pública", "SECRETARIA", "nada", "Analista de recursos humanos", "Auxiliar contable senior", "todero", ""]


def family_sql(x: str) -> str:
    terms = sorted(((t, f) for f, ts in dictionaries.FAMILIES.items() for t in ts), key=lambda p: (-len(p[0]), p[0]))
    exact = " ".join(f"WHEN {x} = '{t}' THEN '{f}'" for t, f in terms)
    within = " ".join(f"WHEN contains({x}, '{t}') THEN '{f}'" for t, f in terms if len(t) >= 5)
    return f"CASE {exact} {within} END"


@C.add(f"SELECT id, {family_sql('f')} AS family FROM (SELECT id, {fold('x')} AS f FROM {corpus.listed_sql(TITLES)})", aside=True)
def job_family(spark: SparkSession, d: str) -> DataFrame:
    return corpus.listed(spark, TITLES).select("id", dictionaries.job_family(F.col("x")).alias("family"))


SPOTS = ["Vivo en Cúcuta, Norte de Santander", "Villa del Rosario", "de Santander y Cali", "Medelin centro", "Bucaramnga", "calixto", "", "Los patios (N. de S.)", "PASTO", "santa marta o pereira"]


@C.add(
    f"""WITH s AS (SELECT id, ' ' || regexp_replace({fold('x')}, '[^a-z0-9]+', ' ', 'g') || ' ' AS f FROM {corpus.listed_sql(SPOTS)}), p AS (SELECT * FROM {corpus.sql_values([(p, dictionaries._folded(p)) for p in dictionaries.PLACES], 'place, k')})
SELECT s.id, (SELECT place FROM p WHERE contains(f, ' ' || k || ' ') ORDER BY position(' ' || k || ' ' IN f), -length(place), place LIMIT 1) AS place,
(SELECT place FROM (SELECT place, levenshtein(w, k) AS d, i, length(place) AS n FROM p, (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT list_filter(string_split_regex(f, '[^a-z]+'), lambda w: length(w) >= 4) AS ws)) t WHERE NOT contains(place, ' '))
 WHERE d <= greatest(1, n // 8) ORDER BY d, i, place LIMIT 1) AS fuzzy FROM s""", aside=True
)
def place_lookup(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return corpus.listed(spark, SPOTS).select("id", dictionaries.find_place(x).alias("place"), dictionaries.fuzzy_place(x).alias("fuzzy"))


KNOW = ["Manejo de Excel y Word", "javascript, SQL", "java y python", "primeros auxilios; trabajo en alturas", "keyword despachos", "", "montacargas/inventarios"]
ALL_SKILLS = [(c, s) for c, ss in dictionaries.SKILLS.items() for s in ss]


@C.add(
    f"SELECT id, category, skill FROM (SELECT id, {fold('x')} AS f FROM {corpus.listed_sql(KNOW)}), {corpus.sql_values(ALL_SKILLS, 'category, skill').replace(' v(', ' w(')} WHERE regexp_matches(f, '(?:^|[^a-z0-9])' || skill || '(?:$|[^a-z0-9])')", aside=True
)
def skills_tagging(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.listed(spark, KNOW).select("id", F.explode(dictionaries.skills(F.col("x"))).alias("s"))
    return found.select("id", "s.*")


# Accuracy: a benchmark item against what a reader that loses letters would have got.
FIELDS = "p AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'summary~' WHEN 1 THEN 'position' WHEN 2 THEN 'phone' ELSE 'city' END AS key, 't' || (item_id % 3) AS template, CASE WHEN item_id % 2 = 0 THEN 'limpio' ELSE 'duro' END AS profile, {f} AS expected, CASE WHEN item_id % 7 = 0 THEN '' WHEN item_id % 5 = 0 THEN substr({f}, 1, 12) WHEN item_id % 4 = 1 THEN replace({f}, 'th', 't') ELSE {f} END AS got FROM benchmark)".replace(
    "{f}", "trim(regexp_replace(strip_accents(lower(text)), '[^a-z]+', ' ', 'g'))"
)
E_, G_ = "trim(expected)", "trim(got)"
_DIGITS = "1.0"
STATES = f"""{FIELDS}, s AS (SELECT *, CASE WHEN key = 'summary~' THEN CASE WHEN {E_} = '' OR {G_} = '' THEN CASE WHEN {E_} = {G_} THEN 1.0 ELSE 0.0 END WHEN contains({G_}, {E_}) OR contains({E_}, {G_}) THEN 1.0
  WHEN len(list_filter(string_split({E_}, ' '), lambda w: length(w) >= 5 AND contains({G_}, w))) > 0 THEN greatest({similarity(E_, G_)}, 0.92) ELSE {similarity(E_, G_)} END
  WHEN key = 'phone' THEN 1.0 ELSE {similarity(E_, G_)} END AS score FROM p),
c AS (SELECT *, CASE WHEN {G_} = '' THEN 'vacio' WHEN score >= {compare.HIT} THEN 'acierto' WHEN score >= {compare.NEAR} THEN 'casi' ELSE 'error' END AS state FROM s)"""


def field_pairs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    f = F.trim(F.regexp_replace(text.fold_only(F.col("text")), "[^a-z]+", " "))
    got = F.when(i % 7 == 0, "").when(i % 5 == 0, F.substring(f, 1, 12)).when(i % 4 == 1, F.replace(f, F.lit("th"), F.lit("t"))).otherwise(f)
    key = F.when(i % 4 == 0, "summary~").when(i % 4 == 1, "position").when(i % 4 == 2, "phone").otherwise("city")
    return views.read(spark, d, "benchmark").select(
        "item_id", key.alias("key"), F.concat(F.lit("t"), i % 3).alias("template"), F.when(i % 2 == 0, "limpio").otherwise("duro").alias("profile"), F.array(f).alias("expected"), F.array(got).alias("got"),
    )


@C.add(f"WITH {STATES} SELECT item_id, key, score, state FROM c")
def field_compare(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.compared(field_pairs(spark, d)).select("item_id", "key", "score", "state")


@C.add(
    f"""WITH {STATES} SELECT key, template, profile, grouping(key, template, profile) AS level, count(*) AS n, count(*) FILTER (WHERE state = 'acierto') AS hits, count(*) FILTER (WHERE state = 'casi') AS near,
CAST(count(*) FILTER (WHERE state = 'acierto') AS DOUBLE) / count(*) AS rate, round(avg(score), 9) AS mean_score FROM c GROUP BY GROUPING SETS ((key), (template), (profile), ())"""
)
def accuracy_cube(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.cube(accuracy.compared(field_pairs(spark, d))).withColumn("mean_score", F.round("mean_score", 9))


@C.add(f"WITH {STATES} SELECT key, kind, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY key) AS share FROM (SELECT key, CASE WHEN trim(got) = '' THEN 'vacio' WHEN contains(got, expected) OR contains(expected, got) THEN 'parcial' WHEN length(got) > 2 * length(expected) THEN 'exceso' ELSE 'distinto' END AS kind, count(*) AS n FROM c WHERE state != 'acierto' GROUP BY 1, 2)")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.taxonomy(accuracy.compared(field_pairs(spark, d)))


@C.add("SELECT count(*) AS n, round(covar_pop(x, y) / sqrt(greatest(var_pop(x) * var_pop(y), 1e-9)), 9) AS correlation FROM (SELECT CAST(length(text) AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id))")
def confidence_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = views.read(spark, d, "documents").join(views.read(spark, d, "labels"), "doc_id").select(F.length("text").cast("double").alias("x"), F.col("quality").cast("double").alias("y"))
    return accuracy.correlation(rows, "x", "y").withColumn("correlation", F.round("correlation", 9))


PEOPLE = [
    (1, 1, "Ana María Prueba", "12.345.678"), (2, 2, "Prueba Ana María", None), (3, 3, None, "12345678"), (4, 4, "Luis Ensayo Gómez", None), (5, 5, "GOMEZ LUIS ENSAYO", None),
    (6, 6, None, None), (7, 7, "Luz Ficticia", "45 678 901"), (8, 8, "Luz F.", None), (9, 9, "Luz Ficticia Rojas", None), (10, 10, "de la", None), (11, 11, "Ana Prueba", "98765432"),
]


@C.add(
    f"""WITH d AS (SELECT * FROM {corpus.sql_values(PEOPLE, 'doc_id, pos, name, document_number')}),
t AS (SELECT *, nullif(regexp_replace(document_number, '[.\\s-]', '', 'g'), '') AS k, list_distinct(list_filter(string_split_regex({fold('name')}, '[^a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ('de', 'del', 'la', 'las', 'los', 'y', 'san'))) AS w FROM d),
known AS (SELECT k, arg_min(name, pos) AS name, arg_min(w, pos) AS w, min(pos) AS pos FROM t WHERE k IS NOT NULL AND name IS NOT NULL GROUP BY k),
m AS (SELECT t.doc_id, arg_min(known.k, known.pos * 1000) AS found FROM t JOIN known ON t.k IS NULL AND len(list_intersect(t.w, known.w)) > 0
  AND ({fold('t.name')} = {fold('known.name')} OR least(len(t.w), len(known.w)) > 0 AND len(list_intersect(t.w, known.w)) >= least(least(len(t.w), len(known.w)), 2)) GROUP BY 1)
SELECT t.doc_id, CASE WHEN t.k IS NOT NULL THEN 'id:' || t.k WHEN found IS NOT NULL THEN 'id:' || found WHEN len(w) > 0 THEN 'name:' || array_to_string(list_sort(w), ' ') ELSE 'sin identificar' END AS "group" FROM t LEFT JOIN m USING (doc_id)""", aside=True
)
def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.entity_groups(spark.createDataFrame(PEOPLE, "doc_id int, pos int, name string, document_number string"))


@C.add(
    """WITH e AS (SELECT user_id AS "group", event_id AS pos, event_type AS kind, value AS confidence, event_id % 11 AS size, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS name, CASE WHEN event_id % 4 = 0 THEN 'c' || event_id END AS city FROM events),
k AS (SELECT "group", kind, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, p) AS nth FROM (SELECT "group", kind, count(*) AS n, min(pos) AS p FROM e GROUP BY 1, 2))
SELECT e."group", count(*) AS n, arg_min(name, pos) FILTER (WHERE name IS NOT NULL) AS name, arg_max(city, pos) FILTER (WHERE city IS NOT NULL) AS city, round(avg(confidence), 3) AS confidence, CAST(sum(size) AS BIGINT) AS size, min(k.kind) AS kind
FROM e JOIN k ON k."group" = e."group" AND nth = 1 GROUP BY 1"""
)
def consolidate_person(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = views.read(spark, d, "events").select(
        F.col("user_id").alias("group"), i.alias("pos"), F.col("event_type").alias("kind"), F.col("value").alias("confidence"), (i % 11).alias("size"),
        F.when(i % 3 == 0, F.concat(F.lit("n"), i)).alias("name"), F.when(i % 4 == 0, F.concat(F.lit("c"), i)).alias("city"),
    )
    return grouping.person_record(rows).withColumn("confidence", F.round("confidence", 3))


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """Two columns under a title on every page: the words of the conversations, laid out on a grid."""
    talk = views.read(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.split("text", r"\s+").alias("w"))
    words = talk.select("doc_id", "page", F.posexplode("w").alias("seq", "text")).where("text != ''")
    row, side = F.floor(F.col("seq") / 6), F.floor(F.col("seq") % 6 / 3)
    return words.select(
        "doc_id", "page", "seq", "text", (50 + side * 280 + F.col("seq") % 3 * 70).cast("double").alias("x"), (40 + row * 14 + F.col("seq") % 2).cast("double").alias("y"),
        F.lit(60.0).alias("width"), F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"), (row == 0).alias("is_bold"), F.lit(0.9).alias("confidence"),
    )


@C.add()
def layout_rows(spark: SparkSession, d: str) -> DataFrame:
    words = layout.clean_words(page_words(spark, d)).drop("uncertain")
    return layout.rows_of(words).groupBy("doc_id", "page", "row").agg(F.count("*").alias("n_words"))


@C.add()
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    words = layout.clean_words(page_words(spark, d)).drop("uncertain")
    found = layout.reading_order(layout.lines_of(layout.columns_of(layout.rows_of(words), 595.0)))
    return found.select("doc_id", "page", "band", "col", "pos", "text", "is_bold")


BOXES = "box AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS page, l_linenumber % 2 AS col, l_linenumber * 1000 + l_partkey % 1000 AS pos, CAST(l_linenumber * 10 + l_quantity % 7 AS DOUBLE) AS y, CAST(l_linenumber * 10 + l_quantity % 7 + 12 AS DOUBLE) AS y2 FROM lineitem)"


@C.add(
    f"""WITH {BOXES}, j AS (SELECT a.doc_id, a.pos AS label_pos, b.pos AS value_pos, least(a.y2, b.y2) - greatest(a.y, b.y) AS shared FROM box a JOIN box b ON a.doc_id = b.doc_id AND a.page = b.page AND a.col != b.col WHERE a.col = 0 AND b.y <= a.y2 AND b.y2 >= a.y)
SELECT DISTINCT doc_id, label_pos, value_pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label_pos ORDER BY shared DESC, value_pos) AS nth FROM j WHERE shared >= 2) WHERE nth = 1"""
)
def spatial_counterpart(spark: SparkSession, d: str) -> DataFrame:
    n, y = F.col("l_linenumber"), (F.col("l_linenumber") * 10 + F.col("l_quantity") % 7).cast("double")
    boxes = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("page"), (n % 2).alias("col"), (n * 1000 + F.col("l_partkey") % 1000).alias("pos"), y.alias("y"), (y + 12).alias("y2"))
    return layout.counterpart(boxes, F.col("col") == 0).distinct()


PLACED = "box AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 2 AS page, l_partkey % 2 AS col, ((l_linenumber * 1000000 + l_partkey) * 2 + l_suppkey % 2) * 100 + CAST(l_quantity AS BIGINT) AS pos, CAST(l_linenumber * 23 + l_quantity AS DOUBLE) AS y, CAST(l_linenumber * 23 + l_quantity + 6 + l_partkey % 9 AS DOUBLE) AS y2, l_returnflag = 'N' AS label FROM lineitem)"


@C.add(
    f"""WITH {PLACED}, j AS (
  SELECT a.doc_id, a.pos AS label_pos, b.pos AS value_pos, b.y AS top, least(a.y2 + {geometry.REACH}, b.y2) - greatest(a.y - {geometry.REACH}, b.y) AS shared, (a.y2 - a.y) * {geometry.HEIGHTS} + {geometry.SLACK} AS reach, a.y AS ay, a.y2 AS ay2, b.y2 AS by2
  FROM box a JOIN box b ON a.doc_id = b.doc_id AND a.page = b.page AND a.col != b.col WHERE a.label
), k AS (SELECT *, CASE WHEN shared >= {geometry.SHARED} THEN 'row' WHEN top >= ay2 - {geometry.TOUCH} AND top - ay2 < reach THEN 'below' WHEN by2 <= ay + {geometry.TOUCH} AND ay2 - top < reach THEN 'above' END AS way FROM j
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_pos ORDER BY CASE way WHEN 'row' THEN 0 WHEN 'below' THEN 1 ELSE 2 END, CASE way WHEN 'row' THEN -shared WHEN 'below' THEN top ELSE -top END, value_pos) AS nth FROM k WHERE way IS NOT NULL)
SELECT doc_id, label_pos, value_pos, way FROM r WHERE nth = 1"""
)
def box_partners(spark: SparkSession, d: str) -> DataFrame:
    y = (F.col("l_linenumber") * 23 + F.col("l_quantity")).cast("double")
    boxes = views.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2).alias("page"), (F.col("l_partkey") % 2).alias("col"), (((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 2 + F.col("l_suppkey") % 2) * 100 + F.col("l_quantity").cast("long")).alias("pos"),
        y.alias("y"), (y + 6 + F.col("l_partkey") % 9).alias("y2"), (F.col("l_returnflag") == "N").alias("label"),
    )
    return geometry.partners(boxes.distinct(), F.col("label"))
