"""Evidence, readings and the dossier against rows written out by hand."""

import pytest
from pyspark.sql import functions as F

from cedrela.functions import evidence, readings
from cedrela.operators import dossier


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("el empleador paga el salario", True), ("salario y nit", False), ("contrato con nit y domicilio", True), ("hoja de vida: empleador, salario", False), ("empleador", False), ("contrato a término fijo, salario", False),
    ],
)
def test_contract_signals(spark, text, want):
    assert values(spark, [(text,)], "x string", evidence.contract_signals(F.col("x"))) == [(want,)]


@pytest.mark.parametrize("text, want", [("asunto: x", True), ("fecha: hoy", False), ("para: ana\nde: jefe", True), ("sin justa  causa", True), ("asunto: hoja de vida", False), ("padre: x", False)])
def test_memo_signals(spark, text, want):
    assert values(spark, [(text,)], "x string", evidence.memo_signals(F.col("x"))) == [(want,)]


def test_values_that_are_no_values(spark):
    rows = [("Atentamente",), ("NRTT",), ("ab",), ("Ana Prueba",), ("la Ana",), ("Cali",), ("XYZ",), ("para Ana Ruiz",), (None,)]
    got = values(spark, rows, "x string", evidence.is_garbage(F.col("x")))
    assert [g for g, in got] == [True, True, True, False, False, False, True, False, True]
    got = values(spark, rows[3:5] + rows[7:8], "x string", evidence.is_garbage_name(F.col("x")))
    assert [g for g, in got] == [False, True, True]
    jobs = [("U OFICIO QUE | ADMINISTRADORA",), ("OFICIO QueOPERADOR DE MAQUINA",), ("Auxiliar",), ("CARGO",)]
    assert [g for g, in values(spark, jobs, "x string", evidence.clean_job(F.col("x")))] == ["ADMINISTRADORA", "OPERADOR DE MAQUINA", "Auxiliar", "CARGO"]
    assert values(spark, [("Cali |* ",), ("x",)], "x string", evidence.clean_value(F.col("x"))) == [("Cali",), (None,)]


def test_people_and_emails(spark):
    rows = [("Ana", "Prueba", "", 0), ("Ana", "Prueba", "a@b.co", 0), ("Gerencia", "General", "a@b.co", 2), ("Ana", "", "a@b.co", 2), ("Ana María", None, "x", 0), ("Ana", "Prueba", None, 1)]
    cols = F.col("a"), F.col("b"), [F.col("c")]
    got = values(spark, rows, "a string, b string, c string, n int", evidence.is_cv(*cols, F.col("n"), F.lit(0)), evidence.is_real_person(*cols))
    assert got == [(False, False), (True, True), (False, True), (False, False), (False, True), (True, False)]
    mails = [("x@gmail.com", True), ("x@GMAIL.com.co", True), ("x@om.co", False), ("ana.p@om.co", True), ("x@my.gmail.com", False)]
    assert values(spark, mails, "x string, w boolean", evidence.plausible_email(F.col("x")), "w") == [(w, w) for _, w in mails]


def test_readings(spark):
    text = "Nombre completo: Ana\nCédula: 12.345.678\nana@correo.com  ana@correo.com\nNacida el 2 de marzo de 1991, $ 1.500.000"
    # mail, number, date, amount (whose digits are also a grouped number), and the words nombre completo and cedula
    got = values(spark, [(text,)], "x string", readings.distinct_data(F.col("x"), readings.FORM_DATA), readings.coverage(F.col("x")), readings.form_points(F.col("x")), readings.is_labelled_table(F.col("x")))
    assert got == [(5, 2, 12, True)]
    spaced = "ana@correo . com y CC 12345678, CO123456"
    assert values(spark, [(spaced,)], "x string", readings.distinct_data(F.col("x"), readings.READING_DATA), readings.distinct_data(F.col("x"), readings.FORM_DATA)) == [(3, 0)]
    pages = [(1, 1, "a" * 900, 0.9), (1, 2, "tel 301 555 1234", 0.2), (1, 3, "salario, empresa, cargo", 0.2), (2, 4, "x", 0.1), (2, 5, "x", 0.3)]
    df = spark.createDataFrame(pages, "page int, reading int, text string, confidence double")
    assert sorted(map(tuple, dossier.best_readings(df).collect())) == [(1, 2, 3), (2, 5, 5)]


def test_index_and_sheet(spark):
    c = "struct<first_names:string,last_names:string,document_number:string,phone:string,email:string,birth_date:string,city:string,headline:string,experience:array<string>,education:array<string>>"
    schema = f"folder string, file int, detected string, text string, candidate {c}, position string, salary string, subject string, id_number string, eps string, memo_name string"
    person = lambda first, last, number, jobs, studies: (first, last, number, None, None, None, None, "perfil", jobs, studies)
    rows = [
        ("p", 1, "cv", "", person("Ana", "", None, ["a"], []), None, None, None, None, "vieja", None), ("p", 2, "cv", "", person("Ana", "Prueba", "7", ["b", "a"], ["e"]), None, None, None, "", "nueva", None),
        ("p", 3, "unknown", "Mi RENUNCIA", None, None, None, "Aviso", None, "", "Ana Prueba Ruiz"), ("p", 4, "contract", "contrato", None, "Operaria", "100", "Aviso", None, None, "Ana"), ("q", 5, "unknown", "", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, dossier.person_index(df).collect())) == [("p", 4, 1, 2, "7", "Operaria", "100", ["Aviso", "Renuncia"]), ("q", 1, 0, 0, None, None, None, [])]
    assert sorted(map(tuple, dossier.person_sheet(df).collect())) == [("p", "Ana Prueba", 12, ["a", "b"], ["e"], "nueva", "Ana Prueba Ruiz"), ("q", None, 0, [], [], None, "q")]


def test_identity_orders(spark):
    parts = ("contract", "candidate", "health", "id_card", "settlement", "text")
    rows = [{"contract_number": "1"}, {"candidate_name": "Ana", "text_number": "9"}, {"health_number": "3", "candidate_number": "2"}, {"settlement_number": "5", "text_name": "Luz"}, {}]
    schema = ", ".join(f"{p}_number string, {p}_name string" for p in parts)
    df = spark.createDataFrame([[r.get(f"{p}_{f}") for p in parts for f in ("number", "name")] for r in rows], schema).coalesce(1)
    got = lambda order: [tuple(r[0]) for r in df.select(dossier.identity(order)).collect()]
    assert got("batch") == [("1", None), (None, "Ana"), ("2", None), (None, "Luz"), (None, None)]
    assert got("file") == [(None, None), ("9", None), ("3", None), (None, None), (None, None)]
    assert got("history") == [("1", None), ("9", None), ("2", None), ("5", None), (None, None)]


def test_jobs_numbers_links_and_orphans(spark):
    jobs = [(1, 0, "Operaria", False, "2019", "marzo 2020"), (1, 1, "Jefa", True, "2001", None), (2, 0, "Auxiliar", False, "2018", "2021"), (2, 1, "Otro", False, None, "2021"), (2, 2, "ab", True, None, None), (3, 0, "Mensajera", None, None, None)]
    df = spark.createDataFrame(jobs, "person int, pos int, position string, is_current boolean, start_date string, end_date string")
    assert sorted(map(tuple, dossier.latest_job(df).collect())) == [(1, "Jefa"), (2, "Auxiliar"), (3, "Mensajera")]
    cited = [("f", "C.C. 12.345.678 y cc 98765432"), ("f", "Cedula de ciudadania: 12345678"), ("g", "CC 1.234.567, C.C: 87654321"), ("h", "tel 3001234567")]
    assert sorted(map(tuple, dossier.most_cited_number(spark.createDataFrame(cited, "folder string, text string")).collect())) == [("f", "12345678"), ("g", "1234567")]
    links = spark.createDataFrame([("memorandos", "a b&c"), ("nada", None)], "p string, v string").coalesce(1).select(dossier.route(F.col("p"), "empleado", F.col("v")).alias("x"))
    parts = dossier.route_parts(F.col("x"))
    assert [tuple(r) for r in links.select("x", parts["section"], parts["params"]["empleado"]).collect()] == [("#/memorandos?empleado=a+b%26c", "memorandos", "a b&c"), ("#/lector", "lector", None)]
    rows, parents = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, k int"), spark.createDataFrame([(10,)], "id int")
    assert sorted(map(tuple, dossier.orphans(rows, parents, "k", "cascade").collect()), key=repr) == [(1, 10), (3, None)]
    assert sorted(map(tuple, dossier.orphans(rows, parents, "k", "set null").collect()), key=repr) == [(1, 10), (2, None), (3, None)]
