"""Tables that change together: failures leave nothing visible, replays change nothing, folds agree with plain dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from cedrela.streaming import queue, replay
from cedrela.streaming.store import Store, alive, merged, save_batches

SCHEMA = "id long, seq long, action string, record struct<name:string,part:struct<a:int,b:int>>, cleared array<string>"


def plain(changes):
    """Each change in its order, on a dictionary."""
    there = {}
    for i, _, action, record, cleared in sorted(changes, key=lambda c: c[1]):
        name, (a, b) = record if record else (None, (None, None))
        if action == "delete":
            there.pop(i, None)
        elif action == "create":
            there[i] = {"name": name, "part.a": a, "part.b": b}
        if action != "delete" and i in there:
            there[i].update({k: v for k, v in (("name", name), ("part.a", a), ("part.b", b)) if v is not None})
            there[i].update(dict.fromkeys(cleared or []))
    return sorted((i, r["name"], r["part.a"], r["part.b"]) for i, r in there.items())


def made(seed, n=300):
    rng = random.Random(seed)
    some = lambda x: x if rng.random() < 0.6 else None
    kinds = ["create", "update", "update", "update", "delete"]
    rows = [(rng.randrange(20), i, rng.choice(kinds), (some(f"n{i}"), (some(i), some(-i))), some([rng.choice(["name", "part.a", "part.b"])]) if rng.random() < 0.3 else None) for i in range(n)]
    return [(i, s, k, None if k == "delete" else r, c) for i, s, k, r, c in rows]


def rows_of(df):
    return sorted((r["id"], r["record"]["name"], r["record"]["part"]["a"], r["record"]["part"]["b"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_merged_against_a_dictionary(spark, seed):
    changes = made(seed)
    shuffled = random.Random(seed).sample(changes, len(changes))
    assert rows_of(merged(spark.createDataFrame(shuffled, SCHEMA))) == plain(changes)


def test_nothing_of_a_batch_is_seen_until_all_of_it_is_there(spark, tmp_path):
    out = str(tmp_path)
    changes = made(9)
    df = spark.createDataFrame(changes, SCHEMA)
    queue.folder(df, f"{out}/in", "seq", 4)
    store = Store(spark, f"{out}/store")
    broken = {"after": 2}

    def second(batch):
        broken["after"] -= 1
        if broken["after"] == 0:
            raise OSError("disk")
        return batch.select("id", "action")

    tables = {"records": lambda b: b, "log": second}
    run = lambda: save_batches(queue.watched(spark, f"{out}/in", df.schema), tables, store, f"{out}/checkpoint")
    with pytest.raises(Exception, match="disk"):
        run()
    assert len(store.manifests()) == 1 and store.changes("records").count() == store.changes("log").count() < 300
    written = store.fs.listStatus(store.path(f"{out}/store/data/records"))
    assert len(written) == 2  # the second batch's rows are there, but no manifest names them
    run()
    assert len(store.manifests()) == 4 and store.changes("log").count() == 300
    assert rows_of(merged(store.changes("records"))) == plain(changes)
    store.save(df, 1, tables)  # a batch that is repeated after its manifest
    assert store.changes("log").count() == 300


def test_compaction_leaves_the_answer_and_late_changes_right(spark, tmp_path):
    changes = made(4)
    early, late = [c for c in changes if c[1] % 3], [c for c in changes if not c[1] % 3]
    store = Store(spark, str(tmp_path))
    same = {"records": lambda b: b, "log": lambda b: b.select("seq")}
    store.save(spark.createDataFrame(early, SCHEMA), 0, same)
    for number in (1, 2):
        store.compact({"records": alive})
        assert len(store.manifests()) == 1 and rows_of(merged(store.changes("records"))) == (plain(early) if number == 1 else plain(changes))
        if number == 1:
            assert store.changes("records").count() < len(early) and store.changes("log").count() == len(early)
            store.save(spark.createDataFrame(late, SCHEMA), 1, same)
    assert store.changes("log").count() == len(changes)
    assert store.changes("nothing") is None and Store(spark, f"{tmp_path}/none").changes("records") is None


def test_updates_of_what_is_not_there_and_ties_of_types(spark):
    df = spark.createDataFrame([(1, 1, "update", ("x", (1, 2)), None), (2, 1, "create", None, None), (2, 2, "update", ("y", (None, 5)), ["part.a"]), (3, 5, "delete", None, None), (3, 4, "create", ("z", (1, 1)), None)], SCHEMA)
    assert rows_of(merged(df)) == [(2, "y", None, 5)]
    assert merged(df.where(F.lit(False))).count() == 0


def test_replay_adds_deltas_only(spark, tmp_path):
    out = str(tmp_path)
    rows = [(f"r{i % 7}", i, "delete" if i % 11 == 10 else "update", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id string, seq long, action string, value double")
    queue.folder(df, f"{out}/in", "seq", 4)
    replay.replay(queue.watched(spark, f"{out}/in", df.schema), f"{out}/rows", f"{out}/checkpoint")
    want = sorted(map(repr, replay.latest(df).where("action != 'delete'").collect()))
    for _ in range(2):
        assert sorted(map(repr, replay.snapshot(spark, f"{out}/rows").collect())) == want
        replay.compact(spark, f"{out}/rows")
    assert Store(spark, f"{out}/rows").changes("rows").count() == 7
