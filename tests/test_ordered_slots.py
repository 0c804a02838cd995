"""Keyed folds with keys in slots: many keys in a call, the same rows, whole numbers as they are."""

from pyspark.sql import functions as F

from cedrela.plans.streams import heartbeat
from cedrela.streaming import employment, ordered, queue
from cedrela.streaming.ordered import SECOND

BIG, T0 = 2**60 + 1, 1_700_000_000  # the epoch itself is late for a stream that begins


def test_keys_share_slots_and_large_numbers_stay(spark, tmp_path):
    """Before, each key had calls of its own, and numbers beside nulls went through doubles."""
    out, fold = str(tmp_path), employment.employment()
    events = [(f"k{k}", (T0 + k * 7 % 5 + s) * SECOND, BIG + 10 * k + s, e) for k in range(12) for s, e in enumerate(["alta", "termina", "alta", "retiro"])]
    df = spark.createDataFrame(events, "k string, at long, id long, event string").withColumn("ts", F.timestamp_micros("at")).drop("at")
    queue.folder(df, f"{out}/in", "id", 2, 2)
    heartbeat(df, "k").coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = ordered.in_order(queue.watched(spark, f"{out}/in", df.schema, 2), "k", fold, "1 day", slots=3)
    ordered.to_files(stream, f"{out}/rows", f"{out}/checkpoint")
    got = sorted(map(repr, spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()))
    want = [spark.createDataFrame([(k, *r) for r in ordered.played(fold, None, [e[1:] for e in events if e[0] == k], None)[1]], stream.schema).collect() for k in {e[0] for e in events}]
    assert got == sorted(repr(r) for rows in want for r in rows)
