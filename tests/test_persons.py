"""Groups of persons over several hops, the bound on pairs, and a person's record, against plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cedrela.functions import names
from cedrela.operators import grouping, persons

SCHEMA = "doc_id long, pos long, name string, document_number string"


def components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_smallest_reachable_against_union_find(spark, seed):
    rng = random.Random(seed)
    name = lambda i: f"n{i:03d}"
    edges = [(name(rng.randrange(120)), name(rng.randrange(120))) for _ in range(70)] + [(name(200 + i), name(201 + i)) for i in rng.sample(range(40), 40)] + [(name(300), name(301 + i)) for i in range(30)]
    got = {r["node"]: r["root"] for r in persons.smallest_reachable(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: r for x, r in components(edges).items() if any(x in e and e[0] != e[1] for e in edges)}


def grouped(spark, rows):
    return {r["doc_id"]: r["group"] for r in persons.person_groups(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_chain_of_names_is_one_person(spark):
    rows = [(1, 1, "Ana Prueba", None), (2, 2, "Ana Prueba Lopez Diaz", None), (3, 3, "Lopez Diaz Marta", None), (4, 4, "MARTA DIAZ DE LA PEÑA", None), (5, 5, "Luis Otro", None), (6, 6, None, None), (7, 7, "Ana", None), (8, 8, "ana", None), (9, 9, "de la", "")]
    got = grouped(spark, rows)
    assert len({got[i] for i in (1, 2, 3, 4)}) == 1 and got[5] == "name:luis otro" and got[6] == got[9] == persons.UNKNOWN
    assert got[7] == got[8] == "name:ana"


def test_numbers_stay_apart_and_take_the_names_that_have_none(spark):
    rows = [(1, 5, "Ana Prueba Lopez", "1.234"), (2, 3, "Ana Prueba Diaz", "99-9"), (3, 4, "Ana Prueba", None), (4, 1, None, "12 34"), (5, 2, "Otra Persona", None), (6, 9, None, None)]
    assert grouped(spark, rows) == {1: "id:1234", 2: "id:999", 3: "id:999", 4: "id:1234", 5: "name:otra persona", 6: persons.UNKNOWN}
    assert grouped(spark, [(1, 1, "Ana Prueba", "7"), (2, 2, None, None), (3, 3, "Prueba Ana", None)]) == {1: "id:7", 2: "id:7", 3: "id:7"}
    assert grouped(spark, [(1, 1, None, None)]) == {1: persons.UNKNOWN} and grouped(spark, []) == {}


def test_a_common_name_makes_no_pairs(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    names = ["maria lopez"] * 100_000 + [f"maria lopez {letters(7)} {letters(7)}" for _ in range(3000)]
    labels = spark.createDataFrame([(n,) for n in names], "name string").select(persons.name_label(F.col("name")).alias("label")).distinct()
    edges = persons.similar_names(labels)
    distinct = {n for n in names}
    assert edges.count() <= sum(len(list(combinations(n.split(), 2))) for n in distinct) < 20_000
    assert len(set(components([tuple(r) for r in edges.collect()]).values())) == 1
    docs = [(i, i, n, None) for i, n in enumerate(names[99_000:])]
    assert len(set(grouped(spark, docs).values())) == 1


def test_record_of_a_person(spark):
    rows = [
        ("a", 2, "Ana", None, "x", 1.0, 10, "t2"), ("a", 1, None, "old", "y", 0.5, None, "t1"), ("a", 3, "Eva", "new", "x", None, 5, None), ("a", 4, None, None, "y", 0.0, 1, "t4"), ("b", 1, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "g string, pos long, name string, city string, kind string, confidence double, size long, text string")
    got = {r["g"]: r for r in persons.synthesis(df, "g", first=["name"], last=["city"], total=["size"], mean=["confidence"], mode=["kind"], joined=["text"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["name"], a["city"], a["size"], a["confidence"], a["kind"], a["text"]) == (4, "Ana", "new", 16, 0.5, "y", "t1\n\nt2\n\nt4")
    assert (b["n"], b["name"], b["city"], b["size"], b["confidence"], b["kind"], b["text"]) == (1, None, None, None, None, None, "")
    jobs = spark.createDataFrame([("a", 3, "Auxiliar", "Tres"), ("a", 1, "Jefe", "Uno"), ("a", 2, "Auxiliar", "Dos"), ("b", 1, None, "x")], "g string, pos long, position string, company string")
    assert [(r["g"], [tuple(x) for x in r["experience"]]) for r in persons.experience(jobs, "g").collect()] == [("a", [("Jefe", "Uno", True), ("Auxiliar", "Dos", False)])]
    ties = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "group string")
    assert tuple(persons.largest_group(ties).first()) == ("a", 2)


def test_entity_groups_against_every_pair(spark):
    rng = random.Random(7)
    words = ["ana", "prueba", "lopez", "diaz", "ruiz", "de", "Ñáñez", "x"]
    rows = [(i, rng.randrange(10_000), None if rng.random() < 0.05 else " ".join(rng.sample(words, rng.randrange(1, 5))), str(rng.randrange(25)) if rng.random() < 0.5 else None) for i in range(160)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = docs.where("document_number IS NOT NULL AND name IS NOT NULL").groupBy(F.col("document_number").alias("key")).agg(F.min_by("name", "pos").alias("known"), F.min("pos").alias("first"))
    shared = F.size(F.array_intersect(names.name_tokens(F.col("name")), names.name_tokens(F.col("known")))) > 0
    pairs = docs.where("document_number IS NULL AND name IS NOT NULL").join(known, names.same_person(F.col("name"), F.col("known")) & shared)
    want = {r["doc_id"]: f"id:{r['key']}" for r in pairs.groupBy("doc_id").agg(F.min_by("key", F.struct("first", "key")).alias("key")).collect()}
    got = {r["doc_id"]: r["group"] for r in grouping.entity_groups(docs).collect()}
    assert want == {i: got[i] for i, _, _, number in rows if number is None and got[i].startswith("id:")}


def test_entity_groups_meet_no_pair_of_names(spark):
    rows = [(i, i, f"comun {chr(97 + i % 26) * 3} {chr(97 + i // 26 % 26) * 4}", str(i) if i % 2 else None) for i in range(4000)]
    out = grouping.entity_groups(spark.createDataFrame(rows, SCHEMA))
    said = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 4000 and said.count("Aggregate [at") == 1 and "known_name" not in said
