"""The CV parser does its whole job: every field of a record, names in headers of any length, whole summaries."""

import json

import __spark_entry__ as entry
from cedrela.operators import people
from cedrela.plans import people as plans


def records(spark, **texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return {r["doc_id"]: r for r in people.cv_records(docs).collect()}


def test_the_query_gives_every_field_of_a_record(spark, tmp_path):
    rows = [(i, x, "es", "a.org", len(x)) for i, x in plans.CV.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["parse_cv_documents"](spark, str(tmp_path))
    assert set(people.cv_records(spark.read.parquet(f"{tmp_path}/documents.parquet")).columns) <= set(out.columns)
    ana = {r["doc_id"]: r for r in out.collect()}[101]
    assert (ana["first_names"], ana["last_names"], ana["city"], ana["n_skills"]) == ("Ana María", "Prueba López", "Cúcuta", 1)
    jobs = [(x["company"], x["position"]) for x in json.loads(ana["experience"])]
    assert jobs == [("Textiles Ejemplo SAS", "auxiliar de bodega"), ("Plásticos Muestra LTDA", "operaria")]
    assert [x["language"] for x in json.loads(ana["languages"])] == ["ingles", "espanol"] and len(json.loads(ana["education"])) == 2 and len(json.loads(ana["references"])) == 2
    assert ana["summary"].startswith("Persona responsable") and json.loads(ana["certifications"]) == ["Trabajo en alturas 2020"]


def test_a_name_is_found_wherever_it_stands_in_the_header(spark):
    far = "\n".join(f"{n}" for n in range(20)) + "\nAna Prueba López\nPERFIL\nuno"
    late = "PERFIL\n" + "\n".join(f"{n}" for n in range(20)) + "\nDATOS PERSONALES\nLuz Ficticia Ruiz"
    other = "REFERENCIAS\nRosa Supuesta Mora"
    below = "PERFIL\n" + "\n".join(f"{n}" for n in range(20)) + "\nRosa Supuesta Mora"
    got = records(spark, far=far, late=late, other=other, below=below)
    assert {k: (r["first_names"], r["last_names"]) for k, r in got.items()} == {"far": ("Ana", "Prueba López"), "late": ("Luz", "Ficticia Ruiz"), "other": (None, None), "below": (None, None)}


def test_a_summary_is_whole(spark):
    lines = [f"Persona responsable en la bodega {n}." for n in range(100)]
    assert records(spark, a="\n".join(["PERFIL", *lines]))["a"]["summary"] == " ".join(lines)


def test_items_are_looked_for_in_all_lines_where_there_is_no_section(spark):
    bare = """Ana Prueba López
Persona responsable con seis años de trayectoria en bodegas
Textiles Ejemplo SAS
Auxiliar de bodega 2018 - 2021
Bachiller, Colegio Inventado 2012
Inglés avanzado, Francés básico | Alemán
Curso de alturas 2020
Referencia: Luis Ensayo 3105550101
ana.prueba@example.org"""
    r = records(spark, a=bare)["a"]
    assert [(x["company"], x["position"]) for x in r["experience"]] == [("Textiles Ejemplo SAS", "auxiliar de bodega")]
    assert [(x["level"], x["text"]) for x in r["education"]] == [("bachillerato", "Bachiller, Colegio Inventado 2012")]
    assert [tuple(x) for x in r["languages"]] == [("ingles", "avanzado"), ("frances", "basico"), ("aleman", "intermedio")]
    assert r["certifications"] == ["Curso de alturas 2020"] and [x["phone"] for x in r["references"]] == ["3105550101"]
    assert r["summary"] == "Persona responsable con seis años de trayectoria en bodegas"


def test_lines_of_other_sections_give_no_items_where_there_is_a_section(spark):
    r = records(spark, a="Ana Prueba\nCurso de ingles\nIDIOMAS\nInglés B2, Ruso\nInglés\nCURSOS\nAlturas\nPERFIL\nTécnico, habla francés\nEDUCACIÓN\nBachiller")["a"]
    assert [tuple(x) for x in r["languages"]] == [("ingles", "b2"), ("ruso", "intermedio")]
    assert r["certifications"] == ["Alturas"] and [x["text"] for x in r["education"]] == ["Bachiller"]
