"""Folds in event time: streams that come shuffled and in parts against the batch answer, restarts, deadlines, intake."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from cedrela.plans.streams import heartbeat
from cedrela.streaming import employment, ordered, queue
from cedrela.streaming.ordered import SECOND, played

T0 = 1_700_000_000 * SECOND
SCHEMA = "k string, ts timestamp, id long, event string"


def rows(events):
    return [(k, T0 + s * SECOND, i, e) for k, s, i, e in events]


def frame(spark, events, schema="k string, at long, id long, event string"):
    return spark.createDataFrame(rows(events), schema).withColumn("ts", F.timestamp_micros("at")).drop("at")


def staff(seed, keys=12, n=240):
    rng = random.Random(seed)
    kinds = [employment.HIRE, employment.EXIT, employment.CANCEL, employment.END]
    return [(f"k{rng.randrange(keys)}", rng.randrange(60), i, rng.choice(kinds)) for i in range(n)]


def test_employment_by_hand():
    fold = employment.employment()
    events = [(1, 10, "retiro"), (2, 11, "alta"), (3, 12, "alta"), (4, 13, "termina"), (5, 14, "termina"), (6, 15, "cancela"), (7, 16, "alta"), (8, 17, "cancela"), (9, 18, "cancela")]
    state, out = played(fold, None, reversed(events), None)
    assert out == [
        ("employees", None, "activo", "contratado", 2, None, 2), ("contracts", 11, "vigente", None, 2, None, 2), ("contracts", 11, "terminado", "termina", None, 4, 4),
        ("employees", None, "inactivo", "despido_justificado", 2, 6, 6), ("memoranda", 15, "archivado", None, None, None, 6), ("employees", None, "activo", "reingreso", 2, None, 7),
        ("contracts", 16, "vigente", None, 7, None, 7), ("employees", None, "inactivo", "despido_justificado", 2, 8, 8), ("contracts", 16, "terminado", "cancela", None, 8, 8),
        ("memoranda", 17, "archivado", None, None, None, 8), ("memoranda", 18, "archivado", None, None, None, 9),
    ]
    assert state == ("inactivo", 2, None, 9)


def test_state_expires():
    fold = employment.employment(keep_days=10)
    day = employment.DAY
    hire, leave, back = (0, 1, "alta"), (day, 2, "retiro"), lambda at: (at, 3, "alta")
    reasons = lambda events, until: [r[3] for r in played(fold, None, events, until)[1] if r[0] == "employees"]
    assert reasons([hire, leave, back(5 * day)], None) == ["contratado", "retiro", "reingreso"]
    assert reasons([hire, leave, back(12 * day)], None) == ["contratado", "retiro", "contratado"]
    assert played(fold, None, [hire, leave], 20 * day)[0] is None and played(fold, None, [hire], 900 * day)[0] is not None


def test_queue_by_hand():
    fold = queue.queue(5)
    s = SECOND
    end = lambda *events: [r[:2] + r[2:] for r in played(fold, None, events, 100 * s)[1]]
    assert end((0, 1, "intake", None), (s, 2, "start", None), (3 * s, 3, "finish", "ok")) == [("pending", 0, None), ("processing", s, None), ("done", 3 * s, "ok")]
    assert end((0, 1, "intake", None), (s, 2, "start", None), (7 * s, 3, "finish", "late")) == [("pending", 0, None), ("processing", s, None), ("error", 6 * s, "timeout")]
    assert end((0, 1, "intake", None), (s, 2, "start", None), (6 * s, 3, "finish", "just")) [-1] == ("done", 6 * s, "just")
    assert end((0, 1, "start", None), (1, 2, "finish", None)) == []
    assert end((0, 1, "intake", None), (1, 2, "intake", None), (2, 3, "start", None), (3, 4, "fail", "x"), (4, 5, "intake", None)) == [
        ("pending", 0, None), ("processing", 2, None), ("error", 3, "x"), ("pending", 4, None)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_give_the_batch_answer_and_go_on_after_a_stop(spark, tmp_path, seed):
    events = staff(seed)
    random.Random(seed).shuffle(events)
    fold, out = employment.employment(), str(tmp_path)
    df = frame(spark, events)
    want = sorted(map(repr, ordered.in_batch(df, "k", fold).collect()))

    def run():
        stream = ordered.in_order(queue.watched(spark, f"{out}/in", df.schema), "k", fold, "1 day")
        ordered.to_files(stream, f"{out}/rows", f"{out}/checkpoint")
        return spark.read.parquet(f"{out}/rows")

    for i in range(3):
        frame(spark, events[i::5]).coalesce(1).write.mode("append").parquet(f"{out}/in")
    first = run()
    assert first.count() == 0  # nothing is told before the watermark has passed it
    for i in (3, 4):  # the same checkpoint, later
        frame(spark, events[i::5]).coalesce(1).write.mode("append").parquet(f"{out}/in")
    heartbeat(df, "k").coalesce(1).write.mode("append").parquet(f"{out}/in")
    assert sorted(map(repr, run().collect())) == want
    assert sorted(map(repr, run().collect())) == want  # nothing new: nothing twice
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_events_beyond_the_watermark_are_left_out(spark, tmp_path):
    fold, out = employment.employment(), str(tmp_path)
    parts = [[("a", 0, 1, "alta")], [("a", 1000, 2, "retiro")], [("a", 2000, 3, "alta")], [("a", 1, 4, "retiro")]]
    for part in parts:
        df = frame(spark, part)
        df.coalesce(1).write.mode("append").parquet(f"{out}/in")
    heartbeat(df, "k").coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = ordered.in_order(queue.watched(spark, f"{out}/in", df.schema), "k", fold, "10 seconds")
    ordered.to_files(stream, f"{out}/rows", f"{out}/checkpoint")
    got = spark.read.parquet(f"{out}/rows").where("table_name = 'employees'").orderBy("stamp").collect()
    assert [r["reason"] for r in got] == ["contratado", "retiro", "reingreso"]


def test_items_of_an_earlier_session(spark, tmp_path):
    out, fold = str(tmp_path), queue.queue(5)
    df = frame(spark, [("old", 1, 1, "start"), ("old", 3, 2, "finish"), ("new", 1, 3, "start")]).withColumn("detail", F.lit("d"))
    df.coalesce(1).write.parquet(f"{out}/in")
    heartbeat(df, "k").coalesce(1).write.mode("append").parquet(f"{out}/in")
    left = spark.createDataFrame([("old", "pending", T0), ("hung", "processing", T0)], "k string, status string, since long")
    stream = ordered.in_order(queue.watched(spark, f"{out}/in", df.schema), "k", fold, "1 day", left)
    ordered.to_files(stream, f"{out}/rows", f"{out}/checkpoint")
    got = sorted((r["k"], r["status"], (r["at"] - T0) // SECOND, r["detail"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [("hung", "error", 5, "timeout"), ("old", "done", 3, "d"), ("old", "processing", 1, None)]


def test_intake_opens_archives_and_keeps_broken_ones(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/uno.txt", "uno")
        z.writestr("dos.docx", b"x")
        z.writestr(".hidden.txt", "no")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "lote.ZIP").write_bytes(data.getvalue())
    (tmp_path / "in" / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "in" / "sub" / "tres.txt").write_text("tres")
    stream = queue.intake(spark, str(tmp_path / "in"), per_trigger=1)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 3
    got = {(r["path"].rsplit("/in/", 1)[1], r["method"], None if r["content"] is None else bytes(r["content"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("lote.ZIP!a/uno.txt", "txt", b"uno"), ("lote.ZIP!dos.docx", "docx", b"x"), ("bad.zip", "zip", None), ("sub/tres.txt", "txt", b"tres")}
