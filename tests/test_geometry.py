"""Partners of labels against all pairs of a page, and contracts in two columns."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from cedrela.operators import contracts, geometry

BOX = "doc_id string, page int, col int, pos int, y double, y2 double, label boolean"


def plain(rows):
    """Each label against every line of the other column of its page."""
    out = []
    for d, p, c, pos, y, y2, label in rows:
        if not label or c not in (0, 1):
            continue
        others = [r for r in rows if r[0] == d and r[1] == p and r[2] == 1 - c]
        reach = (y2 - y) * geometry.HEIGHTS + geometry.SLACK
        shared = [(-(min(y2 + geometry.REACH, r[5]) - max(y - geometry.REACH, r[4])), r[3]) for r in others]
        shared = [s for s in shared if -s[0] >= geometry.SHARED]
        below = [(r[4], r[3]) for r in others if r[4] >= y2 - geometry.TOUCH and r[4] - y2 < reach]
        above = [(-r[4], r[3]) for r in others if r[5] <= y + geometry.TOUCH and y2 - r[4] < reach]
        for way, found in (("row", shared), ("below", below), ("above", above)):
            if found:
                out.append((d, pos, min(found)[1], way))
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_partners_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"d{rng.randrange(9)}", rng.randrange(3), rng.choice([0, 0, 1, -1]), i, y, y + rng.choice([1.0, 8.0, 12.0]), rng.random() < 0.5) for i in range(500) for y in [float(rng.randrange(0, 900, 3))]]
    df = spark.createDataFrame(rows, BOX).repartition(5)
    got = sorted(map(tuple, geometry.partners(df, F.col("label")).collect()))
    assert got == plain(rows) and len({w for *_, w in got}) == 3
    assert geometry.partners(df.where(F.lit(False)), F.col("label")).collect() == []


def test_pages_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(f"d{i // 60}", i // 20 % 3, i % 2, i, float(i // 2 % 10 * 20), float(i // 2 % 10 * 20 + 10), i % 2 == 0) for i in range(300)]
        got = sorted(map(tuple, geometry.partners(spark.createDataFrame(rows, BOX), F.col("label")).collect()))
        assert got == plain(rows) and len(got) == 150
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


LEFT = ["CONTRATO INDIVIDUAL DE TRABAJO A TERMINO FIJO", "Empleador:", "NIT:", "Domicilio:", "Datos del trabajador", "Trabajador:", "Cédula:", "Cargo:", "Salario:", "Fecha de inicio:", "Fecha de terminación:", "Periodo de prueba: 2 meses"]
RIGHT = [None, "EJEMPLO UNO S.A.S.", "900.111.222-3", "Calle 1 # 2-3", None, "CARLOS PRUEBA VEGA", "1.050.111.222", "OPERADOR", "$ 1.600.000", "12/05/2024", "11/05/2025", None]


def placed(columns, page=0):
    rows, pos = [], 0
    for col, texts in enumerate(columns):
        for i, t in enumerate(texts):
            if t is not None:
                rows.append(("c", page, col if RIGHT[i] else -1, pos, t, 20.0 * i + col, 20.0 * i + 10 + col))
                pos += 1
    return rows


def test_contract_in_two_columns(spark):
    rows = placed([LEFT, RIGHT])
    lines = spark.createDataFrame(rows, "doc_id string, page int, col int, pos int, text string, y double, y2 double")
    docs = spark.createDataFrame([("c", "\n".join(r[4] for r in rows))], "doc_id string, text string")
    got = contracts.contracts(docs, lines).first()
    assert (got["employer_name"], got["employer_tax_id"].replace(".", "").replace("-", ""), got["employer_address"]) == ("EJEMPLO UNO S.A.S.", "9001112223", "Calle 1 # 2-3")
    assert (got["worker_name"], got["worker_document_number"], got["position"], got["salary"]) == ("CARLOS PRUEBA VEGA", "1050111222", "OPERADOR", 1_600_000)
    assert (got["contract_type"], got["start_date"], got["end_date"], got["trial_days"], got["notice_days"]) == ("termino_fijo", date(2024, 5, 12), date(2025, 5, 11), 60, 30)


def test_contract_of_one_column_is_one_record(spark):
    text = "CONTRATO A TERMINO FIJO\nEmpleador: EJEMPLO DOS LTDA\nNIT: 800.111.222-1\nDatos del trabajador\nTrabajador: ANA PRUEBA DIAZ\nCédula: 1.098.111.222\nCargo: Auxiliar\nSalario mensual de $ 1.300.000\nFecha de inicio: 01/02/2024\nDuración: 6 meses\npreaviso de 15 dias"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in contracts.contracts(docs).collect()}
    a = got["a"]
    assert (a["employer_name"], a["worker_name"], a["worker_document_number"], a["salary"]) == ("EJEMPLO DOS LTDA", "ANA PRUEBA DIAZ", "1098111222", 1_300_000)
    assert (a["start_date"], a["end_date"], a["months"], a["notice_days"]) == (date(2024, 2, 1), date(2024, 8, 1), 6, 15)
    assert got["b"]["employer_name"] is None and got["c"]["worker_name"] is None and len(got) == 3


def test_scopes_by_height_and_the_top_of_the_page(spark):
    lines = spark.createDataFrame([("c", 0, 0, 0, "Empleador", 0.0), ("c", 0, 0, 1, "TRABAJADOR:", 50.0), ("c", 0, 1, 2, "Ejemplo S.A.S.", 1.0), ("c", 0, 1, 3, "Ana", 60.0)], "doc_id string, page int, col int, pos int, text string, y double")
    assert {r["pos"]: r["scope"] for r in geometry.in_scopes(lines).collect()} == {0: "employer", 2: "employer", 1: "worker", 3: "worker"}
    found = spark.createDataFrame(
        [("d", 0, 1, "Habilidades", "habilidades", 40.0, 9.0), ("d", 0, 2, "ANA PRUEBA DIAZ", "habilidades", 30.0, 22.0), ("d", 0, 3, "Cali", "encabezado", 300.0, 9.0), ("d", 1, 4, "LUZ OTRA MAS", "referencias", 10.0, 30.0), ("d", 0, 5, "Auxiliar", "habilidades", 35.0, 22.0), ("d", 0, 6, "fin", "perfil", 900.0, 9.0)],
        "doc_id string, page int, pos int, text string, section string, y double, font_size double",
    )
    head = geometry.header_rows(found, F.lit(1000.0))
    assert sorted(r["pos"] for r in head.collect()) == [1, 2, 3, 5]
    assert [tuple(r) for r in geometry.largest_name(head).collect()] == [("d", "ANA PRUEBA DIAZ")]


def test_many_pages_are_worked_on_at_a_time(spark):
    from cedrela.operators import layout

    words = spark.range(4000).selectExpr("concat('d', id DIV 8) AS doc_id", "CAST(0 AS INT) AS page", "CAST(id % 8 AS INT) AS seq", "'x' AS text", "CAST(10 * (id % 2) AS DOUBLE) AS x", "CAST(20 * (id % 8 DIV 2) AS DOUBLE) AS y", "5D AS width", "10D AS height")
    found = layout.columns_of(layout.rows_of(words), 595.0)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["seq"] // 2 == r["row"], r["col"]) for r in found.collect()} == {(True, 0)} and found.count() == 4000
