"""Keyed folds in the order of event time: events that come late, within the watermark, are folded in their place."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds in a second, and in a timer's unit.
SECOND, TIMER = 1_000_000, 1000


@dataclass(frozen=True)
class Fold:
    """What a key's events do to its state.

    step(state, event) and expire(state, at) give the next state and the rows that go out; a state is a tuple like `state`
    (a schema) or None, an event a tuple like `event`, of which `at` (microseconds) and `id` come first. deadline(state) is
    when expire() is due if nothing that comes before it changes the state.
    """

    event: str
    state: str
    row: str
    step: Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]]
    deadline: Callable[[tuple | None], int | None] = field(default=lambda state: None)
    expire: Callable[[tuple | None, int], tuple[tuple | None, list[tuple]]] = field(default=lambda state, at: (None, []))


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def played(fold: Fold, state: tuple | None, events: Iterable[tuple], until: int | None) -> tuple[tuple | None, list[tuple]]:
    """The state and the rows after these events, in the order of at and id, and after all deadlines up to `until`."""
    rows: list[tuple] = []

    def expired(limit: int) -> None:
        nonlocal state
        while (at := fold.deadline(state)) is not None and at < limit:
            state, out = fold.expire(state, at)
            rows.extend(out)

    for event in sorted(events, key=lambda e: e[:2]):
        expired(event[0])
        state, out = fold.step(state, event)
        rows.extend(out)
    if until is not None:
        expired(until + 1)
    return state, rows


def tuples(part: pd.DataFrame, schema: str) -> list[tuple]:
    """The rows of a part as tuples like the schema; what is null is None, and whole numbers are whole."""
    values = []
    for column, kind in (x.split() for x in schema.split(",")):
        whole = kind in ("int", "long", "bigint")
        values.append([None if x is None or x != x else int(x) if whole else x for x in part[column].tolist()])
    return list(zip(*values))


#: Slots that keys are dealt over by their hash. Memory holds the waiting events and the states of one slot at a time.
SLOTS = 256


class Ordered(StatefulProcessor):
    """Holds events until the watermark has passed them, then folds them in order, key by key.

    Keys come in slots, so that a call and its exchanges with the store serve many keys. A slot's list states have the events that
    wait and what is folded so far, each with its key; the value state is when something is due next, for which there is a timer: the
    earliest event that waits, or a state's deadline. A key without a state and without waiting events takes no room.
    """

    def __init__(self, fold: Fold, key: str, kind: str):
        self.fold, self.key = fold, key
        self.event, self.held = (f"{key} {kind}, {x}" for x in (fold.event, fold.state))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.event)
        self.states = handle.getListState("states", self.held)
        self.next = handle.getValueState("next", "at long")

    def wake(self, at: int) -> None:
        """Sees to it that the slot is looked at when this is due."""
        if not self.next.exists() or at < self.next.get()[0]:
            self.next.update((at,))
            self.handle.registerTimer(-(-at // TIMER))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        if not pd.isna(key[0]):  # null: what only moves the watermark
            new = [x for part in rows for x in tuples(part, self.event)]
            self.waiting.appendList(new)
            self.wake(min(e[1] for e in new))
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        given = tuples(initialState, self.held)
        self.states.appendList(given)
        due = [at for x in given if (at := self.fold.deadline(x[1:])) is not None]
        if due:
            self.wake(min(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs() * TIMER
        if not self.next.exists() or self.next.get()[0] > now:  # an earlier timer has seen to it
            return
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        states = {x[0]: tuple(x[1:]) for x in self.states.get()} if self.states.exists() else {}
        due: dict = {k: [] for k, state in states.items() if (at := self.fold.deadline(state)) is not None and at <= now}
        for e in events:
            if e[1] <= now:
                due.setdefault(e[0], []).append(e[1:])
        rest, rows = [e for e in events if e[1] > now], []
        for k, mine in due.items():
            state, out = played(self.fold, states.pop(k, None), mine, now)
            rows += [(k, *r) for r in out]
            if state is not None:
                states[k] = state
        for held, left in ((self.waiting, rest), (self.states, [(k, *state) for k, state in states.items()])):
            if left:
                held.put(left)
            elif held.exists():
                held.clear()
        self.next.clear()
        later = [e[1] for e in rest] + [at for state in states.values() if (at := self.fold.deadline(state)) is not None]
        if later:
            self.wake(min(later))
        if rows:
            yield pd.DataFrame(rows, columns=[self.key, *names(self.fold.row)], dtype=object)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, fold: Fold, delay: str, initial: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """The rows of a fold over a stream of events (key, ts, id and what else the fold's events have), key by key.

    delay: how much later than the newest an event may come; what comes later still is dropped, as Spark does.
    initial (key, and the columns of the fold's state): states that keys have before the first event.
    slots: over how many slots keys are dealt; it must stay the same for a checkpoint.
    """
    columns = [c for c in names(fold.event) if c != "at"]
    kind = dict(events.dtypes)[key]
    slot = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key).cast(kind)), F.lit(slots))).alias("_slot")
    sent = events.select(slot, key, "ts", F.unix_micros("ts").alias("at"), *columns).withWatermark("ts", delay)
    before = None if initial is None else initial.select(slot, F.col(key).cast(kind).alias(key), *names(fold.state)).groupBy("_slot")
    return sent.groupBy("_slot").transformWithStateInPandas(Ordered(fold, key, kind), f"{key} {kind}, {fold.row}", "append", "EventTime", initialState=before)


def in_batch(events: DataFrame, key: str, fold: Fold, until: int | None = None) -> DataFrame:
    """The same rows out of a table that is complete; deadlines up to `until` (microseconds) are kept."""
    columns = names(fold.event)
    kind = dict(events.dtypes)[key]

    def run(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        events = [tuple(None if pd.isna(x) else x for x in r) for r in part[columns].astype(object).itertuples(index=False, name=None)]
        return pd.DataFrame([(keys[0], *r) for r in played(fold, None, events, until)[1]], columns=[key, *names(fold.row)])

    rows = events.withColumn("at", F.unix_micros("ts")).select(key, *columns)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, {fold.row}")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the store on RocksDB; the session's own setting comes back afterwards."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off what is there and appends the rows to files; the same call with the same checkpoint goes on from there."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
