"""Jobs around ranges of dates, companies without a legal form, and addresses with a misread sign, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from cedrela.functions import repair, shapes
from cedrela.operators import experience, lines

WORK = """Textiles Ejemplo SAS
Auxiliar de bodega
2018 - 2021
- recibir mercancia
• ordenar estantes
Fin de la lista
Auxiliar contable | enero 2015 - diciembre 2017
Comercializadora Modelo
* cuadrar caja
Operario - Industrias Muestra 2010 - 2012"""


def test_jobs(spark):
    docs = spark.createDataFrame([("a", WORK), ("b", "sin fechas"), ("c", None)], "doc_id string, text string")
    got = sorted(experience.jobs(lines.of_text(docs)).collect(), key=lambda r: r["nth"])
    assert [(r["nth"], r["company"], r["position"], r["duties"]) for r in got] == [
        (1, "Textiles Ejemplo SAS", "Auxiliar de bodega", ["recibir mercancia", "ordenar estantes"]),
        (2, "Comercializadora Modelo", "Auxiliar contable", ["cuadrar caja"]),
        (3, "Industrias Muestra", "Operario", []),
    ]
    assert [str(r["start"])[:4] for r in got] == ["2018", "2015", "2010"]


def test_companies(spark):
    yes = ["Textiles Ejemplo SAS", "Grupo Uno", "Almacén Modelo del Norte", "Tienda 24 Horas", "Hospital Ejemplo Central"]
    no = ["2018 - 2021", "A", "Aseador", "auxiliar contable", "minuscula sola", "EXPERIENCIA LABORAL Y OTRA", "Ana Sol", ""]
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert [r["x"] for r in df.where(shapes.is_company(F.col("x"))).collect()] == yes


KNOWN, SHAPE, SIGNS = re.compile(shapes.KNOWN_DOMAIN), re.compile(shapes.DOMAIN_SHAPE), repair.AT_SIGNS


def user_ok(u):
    return bool(re.fullmatch("[A-Za-z0-9_.+-]{2,}", u) and re.search("[A-Za-z]", u))


def plain(text, strict):
    """Line by line, as the docstring says."""
    found = []
    for line in text.split("\n"):
        words = [w for w in re.split(r"[ \t]+", line) if w]
        for a, b in zip(words, words[1:]):
            cuts = [(a[:-k], b) for k in (2, 1) if len(a) > k and all(c in SIGNS for c in a[-k:])] + [(a, b[k:]) for k in (1, 2) if len(b) > k and all(c in SIGNS for c in b[:k])]
            cuts = [(u, d) for u, d in cuts if user_ok(u)]
            best = next(((u, d) for u, d in cuts if KNOWN.search(d)), None) or next(((u, d) for u, d in cuts if SHAPE.search(d)), None)
            if best:
                found.append("@".join(best))
        for w in words:
            if re.search(r"\.[A-Za-z]{2,}$", w):
                for i in range(1, len(w) - 3):
                    u, d = w[:i], w[i + 1 :]
                    if w[i] in SIGNS and user_ok(u) and (KNOWN.search(d) or (SHAPE.search(d) and "." in u)):
                        found.append(f"{u}@{d}")
    found = [x.lower() for x in found]
    return next((x for x in found if not strict or KNOWN.search(x.split("@")[1]) or "." in x.split("@")[0]), None)


def test_rebuilt_addresses(spark):
    rng = random.Random(6)
    parts = ["ana.prueba", "ana", "Luz_9", "gmail.com", "hotmail.com", "ejemplo.co", "C", "OQ", "0", "@", " ", " ", "\n", ".", "xy.com.co", "texto"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(1500)] + ["ana.pruebaCgmail.com", "martha.caicedoOQ correo.com", "nada", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    for strict in (False, True):
        got = {r["id"]: r["m"] for r in df.select("id", repair.rebuilt_email(F.col("x"), strict).alias("m")).collect()}
        wrong = [(t, got[i], plain(t, strict)) for i, t in enumerate(texts) if got[i] != plain(t, strict)]
        assert not wrong, wrong[:5]
        assert sum(m is not None for m in got.values()) > 100
