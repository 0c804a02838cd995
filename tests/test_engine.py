"""Files, layout, streams, people: what SQL doesn't hold."""

import io
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from cedrela.functions import compare, dictionaries, names, numbers, repair
from cedrela.operators import layout, lines
from cedrela.plans import people as people_plans
from cedrela.sources import files, sinks
from cedrela.streaming import replay


def column(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(make(F.col("x"))).collect()]


def word_file(paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD_NS[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿ hola \n mundo \n".encode())
    (tmp_path / "b.docx").write_bytes(word_file(["uno", "dos"]))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.exe").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        for name in ("f/1.txt", "__MACOSX/1.txt", "f/.hid.txt", "f/2.PNG", "f/no.xyz"):
            z.writestr(name, name)
    (tmp_path / "g.zip").write_bytes(b"broken")
    found = files.routed(files.listing(spark, str(tmp_path))).cache()
    method = {r["path"].rsplit("/", 1)[-1]: (r["method"], r["confidence"]) for r in found.collect()}
    assert method["a.txt"] == ("txt", 0.99) and method["d.exe"] == (None, None) and method["e.zip"] == ("zip", None)
    assert [r["text"] for r in files.texts(found.where("method = 'txt'")).collect()] == ["hola \n mundo"]
    words = {r["path"][-6:]: (r["text"], r["error"]) for r in files.word_texts(found.where("method = 'docx'")).collect()}
    assert words == {"b.docx": ("uno\ndos", None), "c.docx": (None, "BadZipFile")}
    members = files.unzipped(found.where("method = 'zip'")).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in members) == ["1.txt", "2.PNG", "g.zip"]
    done = found.where("method = 'txt'").select("path")
    assert files.pending(found, done).count() == 5
    assert files.data_uri(found.where("path LIKE '%d.exe'"), "x/y").first()["uri"] == "data:x/y;base64,eA=="


def test_repaired_rows(spark):
    first = spark.createDataFrame([("a", "x", None), ("b", None, "bad"), ("c", None, "bad")], "path string, text string, error string")
    again = spark.createDataFrame([("a", "new", None), ("b", "fixed", None)], "path string, text string, error string")
    assert sorted(files.repaired(first, again).collect()) == [("a", "x", None), ("b", "fixed", None), ("c", None, "bad")]


def test_recognised_words(spark):
    kind = "doc_id string, page int, blocks array<struct<paragraphs: array<struct<lines: array<struct<words: array<struct<text: string, x: double>>>>>>>>"
    rows = [("a", 0, [([([([("uno", 1.0), ("dos", 2.0)],)],)],)]), ("b", 0, None)]
    assert [r["text"] for r in files.recognised_words(spark.createDataFrame(rows, kind)).orderBy("seq").collect()] == ["uno", "dos"]


def test_pdf_words(spark):
    items = spark.createDataFrame([("d", 0, 0, " Hola ", 12.0, 0.0, 10.0, 700.0, 30.0, 0.0, "Arial-BoldMT", 800.0), ("d", 0, 1, " ", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, "x", 800.0)], "doc_id string, page int, seq int, text string, scale double, skew double, x double, y double, width double, height double, font string, page_height double")
    r = files.pdf_words(items).collect()
    assert len(r) == 1 and r[0]["is_bold"] and abs(r[0]["y"] - 90.4) < 1e-9
    assert files.needs_recognition(files.pdf_words(items)).first()["scanned"]


def test_layout(spark):
    words = []
    for row in range(12):
        for col, x in ((0, 40.0), (1, 330.0)):
            for k in range(2):
                words.append(("d", 0, len(words), f"{'LR'[col]}{row}{'ab'[k]}", x + k * 65, 100.0 + row * 14 + k, 60.0, 10.0, 10.0, False, 0.9))
    words.append(("d", 0, 99, "TITLE", 100.0, 40.0, 400.0, 20.0, 20.0, True, 0.5))
    df = layout.clean_words(spark.createDataFrame(words, layout.WORD)).drop("uncertain")
    got = layout.reading_order(layout.lines_of(layout.columns_of(layout.rows_of(df), 595.0))).orderBy("pos").collect()
    text = [r["text"] for r in got]
    assert text[0] == "TITLE" and got[0]["col"] == -1 and got[0]["is_bold"] and got[0]["confidence"] == 0.5
    assert text[1:13] == [f"L{i}a L{i}b" for i in range(12)] and text[13:] == [f"R{i}a R{i}b" for i in range(12)]
    assert layout.rows_of(df.where("page > 5")).count() == 0


def test_lines(spark):
    df = spark.createDataFrame([(1, "Ana Prueba\n\nEXPERIENCIA LABORAL:\nuno\n2. Educación\ndos"), (2, None), (3, "")], "doc_id int, text string")
    found = lines.sections(lines.of_text(df), lines.heading_kind(F.col("text"))).orderBy("pos").collect()
    assert [(r["pos"], r["section"], r["section_id"]) for r in found] == [(0, "encabezado", 0), (2, "experiencia", 1), (3, "experiencia", 1), (4, "educacion", 2), (5, "educacion", 2)]


def test_numbers_and_names(spark):
    assert column(spark, ["$ 1.234.567", "442,266.00", "999", None], numbers.amount) == [1234567, 442266, None, None]
    assert column(spark, ["3218055469 - 3002808775", "2015 - 2018", "901.167.955-4", "tel (601) 555 0199"], numbers.phone) == ["3218055469", None, None, "(601) 555 0199"]
    pair = spark.createDataFrame([("Ana María Prueba", "PRUEBA ANA"), ("Luis Prueba", "Ana Prueba"), ("José Ñáñez", "jose nanez"), ("", "x")], "a string, b string")
    assert [r[0] for r in pair.select(names.same_person(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_comparison(spark):
    pair = spark.createDataFrame([("Cúcuta", "cucuta", 1.0), ("Calle cuatro norte", "vive en calle quinta", 0.92), ("", "", 1.0), ("a", "", 0.0)], "e string, g string, want double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in pair.select(compare.containment(F.col("e"), F.col("g")), "want").collect())
    lists = spark.createDataFrame([(["uno", "dos"], ["UNO"]), ([], ["x"])], "e array<string>, g array<string>")
    scores = [r[0] for r in lists.select(compare.list_similarity(F.col("e"), F.col("g"))).collect()]
    assert 0.5 <= scores[0] < 0.9 and scores[1] == 1.0


def test_fuzzy_lookup(spark):
    rows = spark.createDataFrame([(1, "bucaramnga"), (2, "medellin"), (3, "zzz")], "id int, x string")
    terms = spark.createDataFrame([("bucaramanga",), ("medellin",)], "term string")
    assert sorted(dictionaries.fuzzy_lookup(rows, "x", terms).collect()) == [(1, "bucaramanga", 1), (2, "medellin", 0)]


def test_repairs(spark):
    want = ["ana.prueba@example.org", "pedro.muestra@gmail.com", "luz_9@hotmail.com", None, "rosa@gmail.com", None, "juan.s@yahoo.com.co"]
    assert column(spark, people_plans.EMAILS, repair.email_in) == want
    got = column(spark, people_plans.GLUED, repair.segmented)
    assert [r and r["text"] for r in got] == ["TERMINO FIJO del contrato", "CESANTIAS DOBLES y vacaciones", "palabra normal", "nombre cedula\ncargo auxiliar", None, ""]


def test_people(spark):
    cv = {r["doc_id"]: r for r in people_plans.parse_cv(spark, "").collect()}
    ana = cv[101]
    assert (ana["first_names"], ana["last_names"], ana["document_number"], ana["phone"], ana["city"]) == ("Ana María", "Prueba López", "12345678", "301 555 1234", "Cúcuta")
    assert [(e["company"], e["position"], e["start"], e["end"]) for e in ana["experience"]] == [("Textiles Ejemplo SAS", "auxiliar de bodega", "2018", "2021"), ("Plásticos Muestra LTDA", "operaria", "2021", "Actual")]
    assert [e["level"] for e in ana["education"]] == ["bachillerato", "tecnico"] and [x["name"] for x in ana["references"]] == ["Luis Ensayo", "Rosa Supuesta"]
    assert cv[102]["email"] == "pedro.muestra99@gmail.com" and cv[102]["last_names"] == "de la Muestra" and cv[103]["first_names"] is None
    c = {r["doc_id"]: r for r in people_plans.parse_contract(spark, "").collect()}
    assert (c[201]["salary"], c[201]["end_date"], c[201]["trial_days"], c[201]["notice_days"]) == (1423500, date(2024, 9, 1), 60, 30)
    assert (c[202]["contract_type"], c[202]["end_date"], c[202]["notice_days"], c[202]["worker_document_number"]) == ("termino_indefinido", None, 15, None)
    assert (c[203]["months"], c[203]["employer_name"]) == (6, None)


def test_replay_in_batches(spark, tmp_path):
    kind = "record_id string, seq long, action string, value int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1, "create", 1), ("b", 2, "create", 2)], [("b", 5, "delete", None), ("c", 4, "create", 4)], [("b", 3, "update", 9), ("a", 6, "update", 7)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        replay.replay(spark.readStream.schema(kind).parquet(source), out, str(tmp_path / "check"))
    assert sorted(tuple(r) for r in replay.snapshot(spark, out).select("record_id", "value").collect()) == [("a", 7), ("c", 4)]


def test_status_across_batches(spark, tmp_path):
    kind = "employee_id long, id long, ts timestamp, target string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda n: datetime(2024, 1, n)
    for part in ([(1, 1, day(1), "inactivo"), (1, 2, day(2), "activo")], [(1, 3, day(3), "activo"), (1, 4, day(4), "inactivo")], [(1, 5, day(5), "activo")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        replay.to_files(replay.transitions(spark.readStream.schema(kind).parquet(source)), out, str(tmp_path / "check"))
    got = spark.read.schema(replay.STATUS).parquet(out).orderBy("id").collect()
    assert [(r["id"], r["event"]) for r in got] == [(2, "contratado"), (4, "retirado"), (5, "reingreso")]
    assert got[2]["hire_date"] == day(2) and got[2]["exit_date"] is None


def test_flat_rows(spark):
    df = spark.createDataFrame([(1, ["a"], ("x", 2))], "someId int, manyThings array<string>, oneThing struct<k: string, n: int>")
    out = sinks.flat_rows(df)
    assert out.columns == ["some_id", "many_things", "one_thing"] and tuple(out.first()) == (1, '["a"]', '{"k":"x","n":2}')
