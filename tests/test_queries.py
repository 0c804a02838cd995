"""Every query against its SQL in DuckDB, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: With those over a few texts, which aren't registered.
QUERIES = entry.queries() | {name: part.C.queries[name] for part in entry.PARTS for name in part.C.aside}
SQL = entry.oracle_sql() | {name: part.C.sql[name] for part in entry.PARTS for name in part.C.aside if name in part.C.sql}
OWN = sorted(n for n in SQL if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_only_queries_over_tables_are_registered():
    aside = {name for part in entry.PARTS for name in part.C.aside}
    assert len(aside) == 20 and not aside & entry.queries().keys() and not aside & entry.oracle_sql().keys()


def test_entry(spark):
    assert {r["alert_type"] for r in entry.entry(spark).collect()} <= {"contrato_vencido", "vencimiento_contrato"}


def test_library_imports_nothing_of_llm():
    for path in (Path(entry.__file__).parent / "cedrela").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
    assert importlib.util.find_spec("cedrela") is not None
