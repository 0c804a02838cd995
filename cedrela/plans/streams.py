"""The change log, status and routing as streams over the events file, each against the batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from ..sources import sinks
from ..streaming import employment, ordered, queue, replay
from ..streaming import store as stores
from .. import views
from . import Catalogue

C = Catalogue()


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = views.read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # as a pattern: a single file is no folder to watch


CHANGES = """change AS (SELECT user_id || ':' || json_extract_string(props, '$.k') AS record_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS action, value FROM events)"""


@C.add(f"WITH {CHANGES} SELECT record_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) AS nth FROM change) WHERE nth = 1 AND action != 'delete'")
def stream_sync_replay(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    changes = event_stream(spark, d).select(F.concat("user_id", F.lit(":"), F.get_json_object("props", "$.k")).alias("record_id"), F.col("event_id").alias("seq"), action.alias("action"), "value")
    out = work_dir(spark, "replay")
    replay.replay(changes, f"{out}/rows", f"{out}/checkpoint")
    return replay.snapshot(spark, f"{out}/rows").select("record_id", "seq", "value")


TARGETS = """target AS (SELECT user_id AS employee_id, event_id AS id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 'activo' ELSE 'inactivo' END AS target FROM events
  WHERE event_type IN ('signup', 'purchase') OR event_type = 'error' AND CAST(json_extract(props, '$.k') AS INT) < 20)"""


@C.add(
    f"""WITH {TARGETS}, s AS (SELECT *, lag(target) OVER w AS before, min(CASE WHEN target = 'activo' THEN ts END) OVER (PARTITION BY employee_id) AS hire_date, count(*) FILTER (WHERE target = 'activo') OVER (w ROWS UNBOUNDED PRECEDING) AS n
FROM target WINDOW w AS (PARTITION BY employee_id ORDER BY ts, id))
SELECT employee_id, id, CASE WHEN target = 'inactivo' THEN 'retirado' WHEN n = 1 THEN 'contratado' ELSE 'reingreso' END AS event, hire_date, CASE WHEN target = 'inactivo' THEN ts END AS exit_date
FROM s WHERE target != coalesce(before, '') AND n > 0"""
)
def stream_status_fold(spark: SparkSession, d: str) -> DataFrame:
    hired, gone = F.col("event_type").isin("signup", "purchase"), (F.col("event_type") == "error") & (views.event_key() < 20)
    events = event_stream(spark, d).where(hired | gone).select(F.col("user_id").alias("employee_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.when(hired, "activo").otherwise("inactivo").alias("target"))
    out = work_dir(spark, "status")
    replay.to_files(replay.transitions(events), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(replay.STATUS).parquet(f"{out}/rows").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("hire_date", "exit_date")})


@C.add("SELECT CASE WHEN event_type IN ('signup', 'error') THEN event_type WHEN value > 50 THEN 'altos' ELSE 'rechazados' END AS sink, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_multi_sink(spark: SparkSession, d: str) -> DataFrame:
    out = work_dir(spark, "sinks")
    other = ~F.col("event_type").isin("signup", "error")
    tests = {"signup": F.col("event_type") == "signup", "error": F.col("event_type") == "error", "altos": other & (F.col("value") > 50)}
    replay.route(event_stream(spark, d), tests, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("sink").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@C.add("SELECT CAST(p_partkey AS VARCHAR) AS record_id, p_name AS name, p_size + CASE WHEN p_size > 25 THEN 100 ELSE 0 END AS size FROM part UNION ALL SELECT 'n' || s_suppkey, s_name, s_nationkey FROM supplier")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    part, supplier = views.read(spark, d, "part"), views.read(spark, d, "supplier")
    stored = part.select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    newer = stored.where("size > 25").select("record_id", F.lit("otro").alias("name"), (F.col("size") + 100).alias("size"))
    new = supplier.select(F.concat(F.lit("n"), "s_suppkey").alias("record_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("size"))
    return replay.upsert(stored, newer.union(new), "record_id", keep=["name"])


@C.add("SELECT CAST(r_regionkey AS VARCHAR) AS record_id, 'create' AS action, 'regions' AS table_name, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS payload FROM region")
def change_log_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.change_log(views.read(spark, d, "region"), "create", "regions", "r_regionkey").select("record_id", "action", "table_name", "payload")


#: Documents as items of a queue: taken in second by second, taken up at once unless they are long, ended by their label.
LONG_TEXT, TIMEOUT = 8000, 300
QUEUE = f"""item AS (
  SELECT d.doc_id, d.source, d.lang, coalesce(n_chars, 0) AS n, l.quality, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id) AS taken FROM documents d LEFT JOIN labels l USING (doc_id)
), started AS (SELECT *, taken + INTERVAL 30 SECOND AS up, CASE WHEN quality IS NOT NULL AND n * 100 <= {TIMEOUT * 1000} THEN n * 100 END AS took FROM item WHERE n <= {LONG_TEXT})"""


def queue_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events of the queue's items, and the items that an earlier session left pending: those in German."""
    labels = views.read(spark, d, "labels").select("doc_id", "quality")
    second = lambda x: F.make_dt_interval(secs=x)
    item = views.read(spark, d, "documents").join(labels, "doc_id", "left").select(
        "doc_id", "source", "lang", F.coalesce("n_chars", F.lit(0)).alias("n"), "quality",
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("taken"),
    )
    event = lambda rows, ts, kind, detail=F.lit(None): rows.select(F.col("doc_id").alias("item"), ts.alias("ts"), (F.col("doc_id") * 3 + {"intake": 0, "start": 1}.get(kind, 2)).alias("id"), F.lit(kind).alias("event"), detail.cast("string").alias("detail"))
    up = F.col("taken") + second(F.lit(30))
    end = up + second(F.col("n") / 10)
    short = item.where(F.col("n") <= LONG_TEXT)
    parts = [
        event(item.where("lang != 'de'"), F.col("taken"), "intake"), event(short, up, "start"),
        event(short.where("quality = 1"), end, "finish", F.col("source")), event(short.where("quality = 0"), end, "fail", F.lit("calidad")),
    ]
    events = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    left = item.where("lang = 'de'").select(F.col("doc_id").alias("item"), F.lit(queue.PENDING).alias("status"), F.unix_micros("taken").alias("since"))
    return events, left


def heartbeat(events: DataFrame, key: str, ts: str = "2200-01-01") -> DataFrame:
    """A row that belongs to no key and only moves the watermark: all that waits is folded."""
    at = {key: F.lit(None), "ts": F.lit(ts).cast("timestamp"), "id": F.lit(0)}
    return events.sparkSession.range(1).select(*[at.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in events.dtypes])


#: Files of a micro-batch, which are read side by side.
FILES = 4


def streamed(events: DataFrame, key: str, fold: ordered.Fold, out: str, batches: int, initial: DataFrame | None = None) -> DataFrame:
    """The rows of a fold over events that come in several files, in no order, and a last one with the heartbeat."""
    spark = events.sparkSession
    queue.folder(events, f"{out}/in", "id", batches, FILES)
    heartbeat(events, key).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = queue.watched(spark, f"{out}/in", events.schema, FILES)
    rows = ordered.in_order(stream, key, fold, "30000 days", initial)
    ordered.to_files(rows, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@C.add(
    f"""WITH {QUEUE}
SELECT doc_id AS item, 'pending' AS status, taken AS at, NULL AS detail FROM item WHERE lang != 'de'
UNION ALL SELECT doc_id, 'processing', up, NULL FROM started
UNION ALL SELECT doc_id, CASE WHEN took IS NULL OR quality = 0 THEN 'error' ELSE 'done' END, CASE WHEN took IS NULL THEN up + INTERVAL {TIMEOUT} SECOND ELSE up + to_milliseconds(took) END,
  CASE WHEN took IS NULL THEN 'timeout' WHEN quality = 0 THEN 'calidad' ELSE source END FROM started"""
)
def batch_queue_states(spark: SparkSession, d: str) -> DataFrame:
    events, left = queue_events(spark, d)
    rows = streamed(events, "item", queue.queue(TIMEOUT), work_dir(spark, "queue"), 4, left)
    return rows.select("item", "status", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "detail")


STAFF = """staff AS (
  SELECT user_id AS k, event_id AS id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 'alta' WHEN event_type = 'click' THEN 'termina' WHEN CAST(json_extract(props, '$.k') AS INT) < 50 THEN 'cancela' ELSE 'retiro' END AS event
  FROM events WHERE event_type != 'view'
), seen AS (
  SELECT *, lag(event) OVER w AS before FROM staff WHERE event != 'termina' WINDOW w AS (PARTITION BY k ORDER BY ts, id)
), moved AS (
  SELECT *, event = 'alta' AND coalesce(before, '') != 'alta' AS starts, event != 'alta' AND before = 'alta' AS leaves FROM seen
), told AS (
  SELECT s.k, s.id, s.ts, s.event, coalesce(m.starts, false) AS starts, coalesce(m.leaves, false) AS leaves FROM staff s LEFT JOIN moved m ON m.k = s.k AND m.id = s.id
), numbered AS (
  SELECT *, count(*) FILTER (WHERE starts) OVER w AS spell, min(CASE WHEN starts THEN ts END) OVER (PARTITION BY k) AS first FROM told WINDOW w AS (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING)
), closing AS (
  SELECT *, max(CASE WHEN starts THEN id END) OVER (PARTITION BY k, spell) AS contract, row_number() OVER (PARTITION BY k, spell, event IN ('cancela', 'termina') ORDER BY ts, id) AS nth FROM numbered
)"""


@C.add(
    f"""WITH {STAFF}
SELECT k AS employee_id, 'employees' AS table_name, NULL AS record_id, 'activo' AS status, CASE WHEN spell = 1 THEN 'contratado' ELSE 'reingreso' END AS reason, first AS since, NULL AS ended, ts AS stamp FROM closing WHERE starts
UNION ALL SELECT k, 'contracts', id, 'vigente', NULL, ts, NULL, ts FROM closing WHERE starts
UNION ALL SELECT k, 'employees', NULL, 'inactivo', CASE WHEN event = 'cancela' THEN 'despido_justificado' ELSE 'retiro' END, first, ts, ts FROM closing WHERE leaves
UNION ALL SELECT k, 'contracts', contract, 'terminado', event, NULL, ts, ts FROM closing WHERE event IN ('cancela', 'termina') AND spell > 0 AND nth = 1
UNION ALL SELECT k, 'memoranda', id, 'archivado', NULL, NULL, NULL, ts FROM closing WHERE event = 'cancela'"""
)
def employment_cascade(spark: SparkSession, d: str) -> DataFrame:
    events = views.read(spark, d, "events").where("event_type != 'view'")
    hired = F.col("event_type").isin("signup", "purchase")
    kind = F.when(hired, employment.HIRE).when(F.col("event_type") == "click", employment.END).when(views.event_key() < 50, employment.CANCEL).otherwise(employment.EXIT)
    events = events.select(F.col("user_id").alias("employee_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), kind.alias("event"))
    rows = streamed(events, "employee_id", employment.employment(), work_dir(spark, "employment"), 5)
    return rows.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("since", "ended", "stamp")})


#: Which of the tables of a batch an event changes, and how.
TABLES = ["employees", "contracts", "settlements", "case_documents", "memoranda", "health", "id_cards", "alerts"]
SAVED = """saved AS (
  SELECT user_id AS id, event_id AS seq, ts, k, value, CASE event_type WHEN 'signup' THEN 'employees' WHEN 'purchase' THEN 'contracts' WHEN 'click' THEN 'settlements' WHEN 'view' THEN 'case_documents'
      ELSE CASE WHEN k < 20 THEN 'memoranda' WHEN k < 40 THEN 'health' WHEN k < 60 THEN 'id_cards' ELSE 'alerts' END END AS table_name,
    CASE WHEN value >= 150 THEN 'delete' WHEN value >= 60 THEN 'create' ELSE 'update' END AS action, CASE WHEN k < 70 THEN 'n' || k END AS name, CASE WHEN value < 90 THEN value END AS base, CASE WHEN k >= 30 THEN k END AS extra, k = 99 AND value < 60 AS clears
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
), reset AS (
  SELECT *, max(CASE WHEN action != 'update' THEN seq END) OVER (PARTITION BY table_name, id) AS since FROM saved
)"""


def changes(events: DataFrame) -> DataFrame:
    """Events as changes of records: id, seq, action, record (with a nested part), cleared, and the table they go to."""
    k, value = views.event_key(), F.col("value")
    by_error = F.when(k < 20, "memoranda").when(k < 40, "health").when(k < 60, "id_cards").otherwise("alerts")
    table = F.create_map(*[F.lit(x) for x in ("signup", "employees", "purchase", "contracts", "click", "settlements", "view", "case_documents")])[F.col("event_type")]
    action = F.when(value >= 150, stores.DELETE).when(value >= 60, stores.CREATE).otherwise(stores.UPDATE)
    amounts = F.struct(F.when(value < 90, value).alias("base"), F.when(k >= 30, k).alias("extra"))
    record = F.struct(F.when(k < 70, F.concat(F.lit("n"), k)).alias("name"), amounts.alias("amounts"), F.col("ts").alias("updated_at"))
    cleared = F.when((k == 99) & (value < 60), F.array(F.lit("amounts.base"), F.lit("name"))).alias("cleared")
    return events.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action"), record.alias("record"), cleared, F.coalesce(table, by_error).alias("table_name"))


@C.add(
    f"""WITH {SAVED}, live AS (SELECT * FROM reset WHERE since IS NOT NULL AND seq >= since), has AS (SELECT table_name, id FROM live WHERE seq = since AND action = 'create')
SELECT table_name, id, arg_max_null(CASE WHEN NOT clears THEN name END, seq) FILTER (WHERE name IS NOT NULL OR clears) AS name, arg_max_null(CASE WHEN NOT clears THEN base END, seq) FILTER (WHERE base IS NOT NULL OR clears) AS base,
  arg_max(extra, seq) FILTER (WHERE extra IS NOT NULL) AS extra, arg_max(ts, seq) AS updated_at FROM live SEMI JOIN has USING (table_name, id) GROUP BY table_name, id"""
)
def batch_save_tables(spark: SparkSession, d: str) -> DataFrame:
    out = work_dir(spark, "save")
    events = views.read(spark, d, "events")
    queue.folder(events, f"{out}/in", "event_id", 4)
    stream = changes(queue.watched(spark, f"{out}/in", events.schema))
    store = stores.Store(spark, f"{out}/store")
    taken = lambda table: lambda batch: batch.where(F.col("table_name") == table).drop("table_name")
    logged = lambda batch: batch.select(F.col("id").cast("string").alias("record_id"), "action", "table_name", F.to_json("record").alias("payload"))
    stores.save_batches(stream, {t: taken(t) for t in TABLES} | {"change_log": logged}, store, f"{out}/checkpoint")
    store.compact(dict.fromkeys(TABLES, stores.alive))
    parts = [stores.merged(store.changes(t)).select(F.lit(t).alias("table_name"), "id", "record.name", "record.amounts.base", "record.amounts.extra", "record.updated_at") for t in TABLES]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows
