"""Order statistics against sorting, the order of a locale, folders of people."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cedrela.operators import order_statistics as ranks
from cedrela.operators import search
from cedrela.sources import files


def rows_of(seed):
    rng = random.Random(seed)
    kinds = [lambda: 1.5, lambda: rng.gauss(0, 1), lambda: rng.choice([0.0, -0.0, 1e300, -1e300, 5e-324]), lambda: float(rng.randint(-3, 3)), lambda: rng.lognormvariate(0, 40), lambda: None]
    group = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    return [(group(), rng.choice(kinds)()) for _ in range(1500)] + [("one", 3.0), ("nulls", None), ("ends", math.inf), ("ends", 1.0), ("ends", 2.0)]


@pytest.mark.parametrize("seed", range(2))
def test_ranks_against_sorting(spark, seed):
    rows = [r for r in rows_of(seed) if r[0] != "ends"]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            want[g] = (len(v), v[0], v[len(v) // 2], v[-1], v[int(0.98 * (len(v) - 1))], None)
    n = F.col("n")
    got = ranks.at_ranks(df, "g", "v", {"first": F.lit(0), "upper": F.floor(n / 2), "last": n - 1, "p98": F.floor(F.lit(0.98) * (n - 1)), "beyond": n})
    assert {r["g"]: tuple(r)[1:] for r in got.collect()} == want
    positives = {g: sorted(x for h, x in rows if h == g and x is not None and x > 0) for g in want}
    medians = {r["g"]: r["median"] for r in ranks.median_of_positives(df, "g", "v").collect()}
    assert medians == {g: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for g, v in positives.items() if v}
    assert {r["g"]: r["median"] for r in ranks.upper_median(df, "g", "v").collect()} == {g: w[2] for g, w in want.items()}


def test_ranks_of_integers_and_of_nothing(spark):
    values = [2**62, -(2**62), 0, 1, 2, 2**62 - 1, 2**62 - 2] * 3
    df = spark.createDataFrame([(1, v) for v in values], "g int, v long")
    assert [r["median"] for r in ranks.upper_median(df, "g", "v").collect()] == [sorted(values)[len(values) // 2]]
    assert ranks.spread(df.where(F.lit(False)), "g", "v").collect() == []


def test_a_group_sends_few_rows_from_each_task(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    got = ranks.upper_median(df, "g", "v").first()["median"]
    assert got == sorted(r["v"] for r in df.collect())[100_000]


def test_locale_order(spark):
    words = ["zeta", "Ñu", "nube", "ñame", "árbol", "abeja", "Oso", "oso", "ósea", "nuez"]
    df = spark.createDataFrame([(1, w) for w in words], "k int, w string")
    got = [r["w"] for r in search.in_locale_order(df, ["k"], "w").orderBy("nth").collect()]
    assert got == ["abeja", "árbol", "nube", "nuez", "ñame", "Ñu", "ósea", "oso", "Oso", "zeta"]
    jobs = spark.createDataFrame([("Aseadora", None), (" ", "Contador senior"), (None, "Buzo"), ("Buzo", "x"), (None, None)], "job string, headline string")
    assert sorted(map(tuple, search.job_facet(jobs).collect())) == [("job", "Buzo", 2), ("job", "Contable y financiero", 1), ("job", "Servicios generales", 1)]


def test_folders_of_people(spark, tmp_path):
    for name in ["Ñáñez/a.jpg", "Nuñez/sub/b.PNG", "Nuñez/c.jpeg", "Zapata.zip", "Ángel.ZIP", "solo texto/d.txt", "suelto.jpg", "Abad/x.tif"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    found = files.people_folders(files.listing(spark, str(tmp_path)), str(tmp_path)).orderBy("nth").collect()
    assert [(r["name"], r["kind"], [p.rsplit("/", 1)[1] for p in r["files"]]) for r in found] == [
        ("Abad", "carpeta", ["x.tif"]), ("Ángel", "zip", ["Ángel.ZIP"]), ("Nuñez", "carpeta", ["c.jpeg", "b.PNG"]), ("Ñáñez", "carpeta", ["a.jpg"]), ("Zapata", "zip", ["Zapata.zip"]),
    ]
