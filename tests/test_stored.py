"""Lookups read only the parts that they need; the load for what changed gives the rows of the whole load."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cedrela.config import DEFAULT
from cedrela.operators import cascade
from cedrela.sources.tables import Tables


def files_read(df):
    """Files that a plan's scans read, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return sum(int(x) for x in re.findall(r"number of files read: (\d+)", plan_metrics(plan)))


def plan_metrics(plan):
    parts, todo = [], [plan]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            parts.append(f"number of files read: {metrics.apply('numFiles').value()}")
        for name in ("finalPhysicalPlan", "plan"):
            try:
                todo.append(getattr(node, name)())
            except Exception:  # noqa: BLE001, S112  not a node that holds another plan
                continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return " ".join(parts)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(60)]) if i % 3 else 7, rng.choice([None, *(f"d{k}" for k in range(50))])) for i in range(3000)]
    out = Tables(spark, str(tmp_path_factory.mktemp("tables")), slots=16)
    out.write("contracts", spark.createDataFrame(rows, "id long, employee_id long, doc_key string"), "employee_id", "doc_key")
    return out, rows


def test_lookup_by_either_key(spark, tables):
    store, rows = tables
    asked = [(1, 7, "d1"), (2, None, "d1"), (3, None, None), (4, 99, "d2"), (5, 12, None), (6, None, "none"), (7, None, "d1"), (2, None, "d1")]
    got = store.lookup("contracts", spark.createDataFrame(asked, "request long, employee_id long, doc_key string"))
    want = [(q, i) for q, e, k in asked for i, x, y in rows if (x == e if e is not None else k is not None and y == k)]
    assert sorted((r["request"], r["found"]["id"]) for r in got.collect()) == sorted(want)
    assert sorted(r["id"] for r in store.rows("contracts").collect()) == [i for i, _, _ in rows]
    many = spark.createDataFrame([(e,) for e in range(0, 60, 2)], "employee_id long")
    assert sorted(r["id"] for r in store.by_key("contracts", many).collect()) == [i for i, e, _ in rows if e is not None and e % 2 == 0]


def test_a_lookup_reads_few_files_and_moves_no_row_of_the_table(spark, tables):
    store, rows = tables
    one = spark.createDataFrame([(12,)], "employee_id long")
    found = store.by_key("contracts", one)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and not re.search(r"Exchange (?:hash|single|range|Rebalance)", text.split("BroadcastExchange")[0])
    assert 0 < files_read(found) < files_read(store.rows("contracts")) / 4
    by_number = store.by_second("contracts", spark.createDataFrame([("d3",)], "doc_key string"))
    assert sorted(r["id"] for r in by_number.collect()) == [i for i, _, k in rows if k == "d3"]


def day(n):
    return date(1998, 1, 1) + timedelta(n)


def people(rng, n=40):
    employees = [(i, rng.choice(["activo", "activo", "inactivo"]), rng.choice([f"{k:08d}" for k in range(30)] + ["", None])) for i in range(n)]
    number = lambda: rng.choice([f"{k:04d}.{k:04d}"[:9] for k in range(5)] + [f"{k:08d}" for k in range(34)] + ["", None])
    contracts = [(i, rng.choice([None, *range(n + 5)]), number(), day(rng.randrange(300)), day(200 + rng.randrange(60)), rng.choice(["vigente", "terminado", "prorroga"])) for i in range(160)]
    settlements = [(i, rng.choice([None, *range(n + 5)]), number(), day(rng.randrange(300))) for i in range(50)]
    return employees, contracts, settlements


def frames(spark, employees, contracts, settlements):
    return (
        spark.createDataFrame(employees, "id long, status string, document_number string"),
        spark.createDataFrame(contracts, "id long, employee_id long, worker_document_number string, start_date date, end_date date, status string"),
        spark.createDataFrame(settlements, "id long, employee_id long, worker_document_number string, exit_date date"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_reload_is_load(spark, seed):
    rng = random.Random(seed)
    employees, contracts, settlements = people(rng)
    loaded = cascade.load(*frames(spark, employees[:-2], contracts[:150], settlements[:46]), DEFAULT)
    before = spark.createDataFrame(loaded.collect(), loaded.schema)
    gone, moved = contracts[3], contracts[9]
    moved_now = (*moved[:1], rng.randrange(40), *moved[2:])
    now = [c for c in contracts if c not in (gone, moved)] + [moved_now]
    changed = [(c[1], c[2]) for c in contracts[150:] + settlements[46:] + [gone, moved, moved_now]] + [(e[0], e[2]) for e in employees[-2:]]
    told = spark.createDataFrame(changed, "employee_id long, document_number string")
    tables = frames(spark, employees, now, settlements)
    got = cascade.reload(before, *tables, told, DEFAULT)
    want = cascade.load(*tables, DEFAULT)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    untouched = cascade.reload(before, *frames(spark, employees[:-2], contracts[:150], settlements[:46]), told.where(F.lit(False)), DEFAULT)
    assert sorted(map(repr, untouched.collect())) == sorted(map(repr, before.collect()))
