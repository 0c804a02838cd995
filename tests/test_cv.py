"""CVs as one record: labels, context, shapes; header and name by place."""

from cedrela.operators import cv, lines

CV = """HOJA DE VIDA
Ana María Prueba López
Auxiliar administrativo
Cédula: 1.098.111.222
Celular: 300 111 2233
ana.prueba@example.org | linkedin.com/in/ana-prueba
Ciudad: Cúcuta
Dirección: Calle 1 # 2-3 | Barrio Uno
Nacionalidad: Colombiana, por nacimiento
Estado civil: Soltera
Fecha de nacimiento: 01/02/1990
Licencia de conducción: categoría b1
Aspiración salarial: $ 1.800.000
PERFIL
Persona responsable con experiencia en archivo y servicio.
EXPERIENCIA LABORAL
EJEMPLO S.A.S.
Auxiliar de archivo 2019 - 2021
EDUCACIÓN
Bachiller académico, Colegio Ejemplo 2008
IDIOMAS
Inglés intermedio"""


def test_every_field_of_a_cv(spark):
    docs = spark.createDataFrame([("a", CV), ("b", None), ("c", "")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in cv.cvs(docs).collect()}
    a = got["a"]
    assert (a["first_names"], a["last_names"], a["headline"]) == ("Ana María", "Prueba López", "Auxiliar administrativo")
    assert (a["document_number"], a["email"], a["city"]) == ("1098111222", "ana.prueba@example.org", "Cúcuta")
    assert a["phone"].replace(" ", "") == "3001112233" and a["social_links"] == ["https://linkedin.com/in/ana-prueba"]
    assert (a["address"], a["nationality"], a["marital_status"], a["birth_date"], a["driver_license"], a["salary"]) == ("Calle 1 # 2-3", "Colombiana", "Soltera", "01/02/1990", "B1", 1_800_000)
    assert a["experience"][0]["company"] == "EJEMPLO S.A.S." and a["education"][0]["level"] == "bachillerato" and a["languages"][0]["language"] == "ingles"
    assert len(got) == 3 and got["b"]["headline"] is None and got["c"]["first_names"] is None


def test_headline_by_label_by_job_and_after_a_label(spark):
    texts = {
        "label": "ANA PRUEBA DIAZ\nNo soy titular\nCargo al que aspira: Contadora.\n3001112233", "job": "3001112233\nana@example.org\nCali\nCalle 1\nAuxiliar contable\nANA PRUEBA DIAZ\n12345", "next": "ANA PRUEBA DIAZ\n3001112233\n1090111222\nana@example.org\nCargo actual\nPiloto de ensayo",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["headline"] for r in cv.cvs(docs).collect()}
    assert got["label"] == "Contadora" and got["job"] == "Auxiliar contable" and got["next"] == "Piloto de ensayo"


def test_shapes_where_nothing_else_is_found(spark):
    docs = spark.createDataFrame([("x", "texto corrido de Ana Prueba con numero 1098111222 y 3001112233 ana@example.org fin")], "doc_id string, text string")
    got = cv.cvs(docs).first()
    assert got["email"] == "ana@example.org" and got["document_number"] == "1098111222"


def test_the_name_is_the_largest_in_the_header(spark):
    rows = [("p", 0, 0, 0, "HABILIDADES", 100.0, 12.0), ("p", 0, 0, 1, "Archivo General Uno", 120.0, 9.0), ("p", 0, 0, 2, "Servicio Ejemplo Dos", 400.0, 9.0), ("p", 0, 1, 3, "LUZ PRUEBA RUIZ", 30.0, 24.0), ("p", 0, 1, 4, "Contadora", 60.0, 12.0), ("p", 0, 1, 5, "PERFIL", 300.0, 12.0), ("p", 0, 1, 6, "Persona de ejemplo que trabaja", 320.0, 9.0)]
    placed = spark.createDataFrame(rows, "doc_id string, page int, col int, pos int, text string, y double, font_size double")
    docs = spark.createDataFrame([("p", "\n".join(r[4] for r in rows))], "doc_id string, text string")
    got = cv.cvs(docs, placed).first()
    assert (got["first_names"], got["last_names"], got["headline"]) == ("LUZ", "PRUEBA RUIZ", "Contadora")
    assert lines.of_text(docs).count() == 7
