"""The change log as a stream: replay by key, routing to sinks, status by keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import store


def latest(changes: DataFrame) -> DataFrame:
    """changes (record_id, seq, action, payload) to the rows that are left: each record's last change, deletions aside.

    A create or an update replaces the row; replaying the same changes twice gives the same rows.
    """
    last = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("seq")))
    return changes.withColumn("nth", last).where("nth = 1").drop("nth")


def replay(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Replays what is there and stops. Every batch adds the last change of each of its records to the store; nothing that
    was written before is written again. Deletions stay as tombstones, so that a late older change can't bring a row back."""
    store.save_batches(stream, {"rows": latest}, store.Store(stream.sparkSession, out), checkpoint)


def snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The rows that are left after all batches."""
    return latest(store.Store(spark, out).changes("rows")).where("action != 'delete'")


def compact(spark: SparkSession, out: str) -> None:
    """Writes the last change of each record as one set of files in place of those of all batches."""
    store.Store(spark, out).compact({"rows": latest})


def route(stream: DataFrame, sinks: Mapping[str, Column], out: str, checkpoint: str) -> None:
    """Writes each batch to several sinks, by a condition each; rows that no condition takes go to `rechazados`. The batch's
    number is part of the path, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        rest = F.lit(True)
        for name, test in sinks.items():
            kept.where(test).write.mode("overwrite").parquet(f"{out}/sink={name}/batch={number}")
            rest = rest & ~F.coalesce(test, F.lit(False))
        kept.where(rest).write.mode("overwrite").parquet(f"{out}/sink=rechazados/batch={number}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


STATUS = "employee_id long, id long, event string, hire_date timestamp, exit_date timestamp"


def transitions(events: DataFrame) -> DataFrame:
    """employee_id, id, event, hire_date, exit_date: contratado, retirado and reingreso events out of a stream of events
    (employee_id, id, ts, target: activo or inactivo), by keyed state.

    An exit needs someone active; a rehire clears the exit and keeps the first hire date. Events of a batch are put in order
    of ts and id; one that comes in a later batch than a newer event is folded when it comes.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, hired = state.get if state.exists else ("", None)
        rows = []
        for r in pd.concat(parts).sort_values(["ts", "id"]).itertuples():
            if r.target == "activo" and status != "activo":
                rows.append((key[0], r.id, "reingreso" if hired is not None else "contratado", hired or r.ts, None))
                status, hired = "activo", hired or r.ts
            elif r.target == "inactivo" and status == "activo":
                rows.append((key[0], r.id, "retirado", hired, r.ts))
                status = "inactivo"
        state.update((status, hired))
        yield pd.DataFrame(rows, columns=["employee_id", "id", "event", "hire_date", "exit_date"])

    return events.groupBy("employee_id").applyInPandasWithState(fold, STATUS, "status string, hired timestamp", "append", GroupStateTimeout.NoTimeout)


def to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """stored with incoming merged over it by key: a new value wins where it isn't null, the columns `keep` stay."""
    names = [c for c in stored.columns if c != key]
    both = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in names]).join(incoming.select(key, *[F.col(c).alias(f"new_{c}") for c in names]), key, "full")
    pick: Callable[[str], Column] = lambda c: F.coalesce(f"old_{c}", f"new_{c}") if c in keep else F.coalesce(f"new_{c}", f"old_{c}")
    return both.select(key, *[pick(c).alias(c) for c in names])
