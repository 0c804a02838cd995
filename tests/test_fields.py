"""Shapes of values and fields by labels against rows written out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from cedrela.functions import classify, dictionaries, shapes
from cedrela.operators import labels, lines, matching

CONTRACT = "CONTRATO\nEmpleador: Industrias Ejemplo SAS\nNIT: 900.123.456-7\nCorreo: jefe@firma.co\nTrabajador:\nMARTHA CAICEDO RUIZ\nIdentificacion: C.C. 1.098.765.432\nCorreo: marta@correo.co\nFecha de inicio\n01/02/2024\nCARGO\nAuxiliar de aseo\nSALARIOO: $ 1.500.000"


def each(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "x string").coalesce(1).select(*columns).collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


PEOPLE = [
    ("MARTHA LUCIA CAICEDO", "MARTHA LUCIA CAICEDO", True), ("Trabajador: 30 dias", "dias", False), ("AV 68 x 40-15", "AV", False), ("Ana", "Ana", False), ("• Ana de la Prueba (CC 1)", "Ana de la Prueba", True),
    ("Ana Prueba @gmail.com", "Ana Prueba", False), ("Trabajador: ANA DE LA PRUEBA 12", "ANA DE LA PRUEBA", True), ("g Ana O'Prueba, correo", "Ana O'Prueba", False), ("Pago quincenal", "Pago quincenal", False), ("", "", False), (None, None, None),
]


def test_people(spark):
    assert each(spark, [p[0] for p in PEOPLE], F.col("x"), shapes.clean_person(F.col("x")), shapes.is_person(F.col("x"))) == PEOPLE


@pytest.mark.parametrize(
    "shape, yes, no",
    [
        (shapes.is_template, ["Identificados como sigue", "el Término fijo"], ["Ana Muestra", "contratos"]),
        (shapes.is_notice, ["Trabajador: 15 días. Empleador: 30 días", "30 dias", "Aviso de terminación"], ["Trabajador: Ana", "20 horas"]),
        (shapes.is_address, ["Cra 4 5-60", "# 12", "Avenida 3"], ["Carreras Ana", "Ana"]),
        (shapes.is_firm, ["Textiles S.A.S", "Pan Ltda.", "Empresa Unipersonal Luz"], ["Salas Ana", "Ltdax"]),
        (shapes.is_job, ["Auxiliar de aseo", "• Soldador"], ["Ana", "Industrias"]),
        (shapes.is_job_not_city, ["CONDUCTOR analista", "Gerencia"], ["Cúcuta", "Director de Cali Norte", ""]),
        (shapes.may_be_city, ["Los Angeles, CA"], ["soy de Cali", "una calle de la ciudad de Cali hoy", "x" * 46]),
        (shapes.has_place, ["vivo en Cúcuta."], ["Calima", ""]),
    ],
)
def test_shapes(spark, shape, yes, no):
    assert each(spark, yes + no, shape(F.col("x"))) == [(True,)] * len(yes) + [(False,)] * len(no)


def test_headlines(spark):
    lines_ = ["Ingeniero de Sistemas", "Boston, MA", "NRTA", "Calle 4 norte", "Cali", "Auxiliar contable in the area", "Asunto: x", "Tel:", "Perfil: 300 4000"]
    got = each(spark, lines_, shapes.may_be_headline(F.col("x"), F.lit("Cali")), shapes.may_be_headline_by_place(F.col("x"), F.lit("Cali")))
    assert got == [(True, True)] + [(False, False)] * 4 + [(True, False)] + [(False, False)] * 3


def test_numbers(spark):
    texts = ["C.C. 1.098.765.432 salario 12345678", "cel 3105550000\nx 87654321", "cedula 9o8765432", "3105550000", "901167955", "900123456 y 7654321", "", None]
    got = each(spark, texts, shapes.generic_id(F.col("x"), F.lit("900.123.456"), ("901167",)))
    assert [g for g, in got] == ["1098765432", "87654321", "908765432", None, None, "7654321", None, None]
    assert each(spark, ["salario: $ 1.500.000", "sueldo mensual de 99", "honorarios: 150000"], shapes.pay_in(F.col("x"))) == [(1500000,), (None,), (None,)]
    assert each(spark, ["NIT No. 900.123.456-7 |", "C.C. 1.098"], shapes.tax_id(F.col("x")), shapes.tax_id_in(F.col("x"))) == [("900.123.456-7", "900.123.456-7"), ("1.098", None)]


def test_parts(spark):
    got = each(spark, ["Textiles SAS - Operario", "Conductor | Transportes X", "Distransa: Conductor", "solo", "a - b", "Analista - Grupo Y - Lima"], shapes.company_and_job(F.col("x")))
    assert [g and tuple(g) for g, in got] == [("Textiles SAS", "Operario"), ("Transportes X", "Conductor"), ("Distransa", "Conductor"), None, None, ("Grupo Y", "Analista")]
    assert each(spark, ["c1", "intermedio", "NATIVO", ""], shapes.capitalised_level(F.col("x"))) == [("C1",), ("Intermedio",), ("Nativo",), ("",)]
    assert tuple(each(spark, ["soy Ana Prueba, cc 12345678 tel 3105550000 A@B.co"], shapes.by_shape(F.col("x")))[0][0]) == ("Ana", "Prueba", "12345678", "3105550000", "a@b.co")
    assert each(spark, ["Atentamente", "contrato de trabajo", "hoja de vida", None], shapes.caption_kind(F.col("x"))) == [("firma",), ("contrato",), ("hoja_de_vida",), ("otro",)]
    assert each(spark, ["anaC", "ana", "anaCO"], shapes.joined_mail(F.col("x"), F.lit("gmail.com"), "CGO"), shapes.joined_mail(F.col("x"), F.lit("Crosimar.com.co"), "CGO")) == [("ana@gmail.com", "ana@Crosimar.com.co"), (None, "ana@rosimar.com.co"), ("ana@gmail.com", "ana@Crosimar.com.co")]
    assert each(spark, ["el cargo a desempeñar: Operario de planta.", "nada"], shapes.job_in_prose(F.col("x"))) == [("Operario de planta",), (None,)]
    years = spark.createDataFrame([(True, "2001", None), (False, "2001", "mayo 2010"), (False, "x", None), (None, "1999", None)], "c boolean, s string, e string").coalesce(1)
    assert [r[0] for r in years.select(shapes.job_order(F.col("c"), F.col("s"), F.col("e"))).collect()] == [(1 << 53) - 1, 2010, 0, 1999]


def test_labels_and_scopes(spark):
    rows = labels.in_scopes(lines.of_text(docs(spark, CONTRACT, "nada", None, "Trabajador: x")))
    assert {(r["doc_id"], r["pos"]): r["scope"] for r in rows.collect() if r["pos"] in (0, 3, 4)} == {(1, 0): "employer", (1, 3): "employer", (1, 4): "worker", (2, 0): None, (4, 0): None}
    fields = {"employer": ["empleador"], "worker": ["trabajador", "empleado"], "mail": ["correo"], "job": ["cargo"], "pay": ["salario"], "none": ["horario"]}
    got = labels.labelled_fields(labels.candidates(rows), fields, {"mail": "worker"}, {"worker": shapes.is_person})
    assert [tuple(r) for r in got.collect()] == [(1, "Industrias Ejemplo SAS", "MARTHA CAICEDO RUIZ", "marta@correo.co", "Auxiliar de aseo", "$ 1.500.000", None)]
    assert [tuple(r) for r in labels.date_near(rows, ["fecha de inicio"]).collect()] == [(1, "2024-02-01")]
    assert [tuple(r) for r in labels.name_above(rows, ["identificacion"]).collect()] == [(1, "MARTHA CAICEDO RUIZ")]
    contract = {r["doc_id"]: r.asDict() for r in labels.contract_parties(docs(spark, CONTRACT, "nada", None)).collect()}
    assert contract[1] == {
        "doc_id": 1, "employer_name": "Industrias Ejemplo SAS", "employer_tax_id": "900.123.456-7", "employer_email": "jefe@firma.co", "employer_address": None, "worker_name": "MARTHA CAICEDO RUIZ", "worker_document_number": "1098765432",
        "worker_email": "marta@correo.co", "worker_address": None, "position": "Auxiliar de aseo", "salary": 1500000, "start_date": "2024-02-01", "end_date": None,
    }
    assert sorted(contract) == [1, 2, 3] and set(contract[2].values()) == {2, None}


def test_no_date_after_another_label(spark):
    rows = lines.of_text(docs(spark, "Fecha de inicio\nnada\n3/4/2020", "Fecha de inicio\nvencimiento\n3/4/2020", "Fecha de inicio: 5/6/2021"))
    assert sorted(map(tuple, labels.date_near(rows, ["fecha de inicio"]).collect())) == [(1, "2020-04-03"), (3, "2021-06-05")]


def test_records(spark):
    text = "Cargo: A\nEmpresa: X\nPeriodo: 2018 - 2020\nEmpresa: Y\nCargo: B\nFecha: 2021 a actualidad\nNivel: tecnico\nTitulo: T 2010\nNivel: bachiller\nColegio: C 2005\nUniversidad: U"
    pairs = lines.labelled_pairs(lines.of_text(docs(spark, text, "Fecha: 2001", None)))
    assert sorted(map(tuple, labels.job_records(pairs).collect())) == [(1, 1, "X", "A", "2018", "2020", False, None), (1, 2, "Y", "B", "2021", "Actual", True, None)]
    assert sorted(map(tuple, labels.study_records(pairs).collect())) == [(1, 1, "tecnico", "T", "", None), (1, 2, "bachillerato", "C", "C", "2005"), (1, 3, "universitario", "U", "U", None)]


def test_context_email_and_header(spark):
    text = "Nombre: Ana María Prueba\nNombre: Otra Persona\nCédula: 12.345.678\nCel: 3105550000\nCiudad: CONDUCTOR\nCiudad: Cúcuta, Norte\nCorreo: A@b.co\nCorreo: c@d.co\nEstado  civil: soltera"
    got = labels.context_fields(lines.of_text(docs(spark, text))).collect()[0].asDict()
    assert {k: v for k, v in got.items() if v is not None} == {"doc_id": 1, "document_number": "12345678", "phone": "3105550000", "email": "c@d.co", "city": "Cúcuta", "marital_status": "soltera", "first_names": "Ana María", "last_names": "Prueba"}
    mails = docs(spark, "Referencias\na@b.co\nx\nmío c@d.co", "Luis Ensayo 3105550101 l@e.co", "solo z@y.co")
    assert sorted(map(tuple, labels.own_email(lines.of_text(mails)).collect())) == [(1, "c@d.co"), (3, "z@y.co")]
    found = lines.sections(lines.of_text(docs(spark, "a\nb\nc\nExperiencia\nd", "a\nReferencias\nz\nIdiomas\ny")), lines.heading_kind(F.col("text")))
    assert sorted((r["doc_id"], r["text"]) for r in labels.header_rows(found).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "Idiomas"), (2, "a"), (2, "y")]


def test_signs_of_a_cropped_cv(spark):
    texts = ["CC 12345678\nCalle 4\n2 de marzo de 1991", "CC 12345678\nCalle 4\nmarzo de 1991", "tel 1, # 3, bachiller", "tel 1, # 3", "1.234.567 3001234567 soltero", None]
    got = classify.classified(docs(spark, *texts)).orderBy("doc_id")
    assert [r["category"] for r in got.collect()] == ["hoja_de_vida", "desconocido", "hoja_de_vida", "desconocido", "hoja_de_vida", "desconocido"]
    assert [r[0] for r in got.select(classify.category(F.col("text"))).collect()] == [r["category"] for r in got.collect()]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_lookup_against_all_pairs(spark):
    chance = random.Random(5)
    terms = ["".join(chance.choices("abcd", k=chance.randint(1, 26))) for _ in range(60)] + ["abcdefghijklmnopqrstuvwx"]

    def misread(t):
        t = list(t)
        for _ in range(chance.randint(0, max(1, len(t) // 5))):
            at = chance.randrange(len(t) + 1)
            t[at : at + chance.randint(0, 1)] = chance.choices("abcdX", k=chance.randint(0, 1))
        return "".join(t)

    texts = [misread(t) for t in terms * 6] + ["aXcXeXghijklmnopqrstuvwX", "", None]
    want = set()
    for i, x in enumerate(texts):
        found = [(distance(x, t), t) for t in terms if distance(x, t) <= 0.18 * max(len(x), len(t))] if x else []
        if found:
            d, t = min(found)
            want.add((i, t, d))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    got = dictionaries.fuzzy_lookup(rows, "x", spark.createDataFrame([(t,) for t in [*terms, None]], "term string"))
    assert {tuple(r) for r in got.collect()} == want


def test_best_matches_are_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 2)
    chance = random.Random(3)
    words = ["excel", "sql", "bodega", "ventas", "ingles"]
    people = [(i, " ".join(chance.sample(words, chance.randint(0, 3))), chance.choice([*words, None]), None, "Cali") for i in range(40)]
    asked = [(v, chance.choice([*words, "nada", " ", "Cali"]), chance.choice([None, 1, 3, 9000]), chance.choice(["habilidad", "experiencia", "otro", "x", None])) for v in range(6) for _ in range(3)]
    c = spark.createDataFrame(people, "id int, skills string, headline string, education string, city string")
    r = spark.createDataFrame([*asked, (9, " ", 1, "otro"), (8, "nada", 1, "otro")], "vacancy_id int, skill_or_req string, weight int, req_type string")
    columns = ["vacancy_id", "place", "candidate_id", "score", "n_matched"]
    want = {tuple(x) for x in matching.top_matches(matching.match_scores(c, r), 7).select(columns).collect()}
    assert {tuple(x) for x in matching.best_matches(c, r, 7).select(columns).collect()} == want
