"""Glued words: the cheapest way against all ways, and whole texts against plain Python."""

import math
import random
import re
from collections import Counter

from cedrela.operators import segmentation as seg

ACCENTS = str.maketrans("áéíóúñü", "aeiounu")


def all_ways(word, price, at=0):
    if at == len(word):
        yield 0, []
    for end in range(at + seg.SHORTEST, min(at + seg.LONGEST, len(word)) + 1):
        if end - at < len(word) and word[at:end] in price:
            for cost, cuts in all_ways(word, price, end):
                yield cost + price[word[at:end]], [end, *cuts]


def test_best_split_against_all_ways():
    rng = random.Random(2)
    for _ in range(400):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(3, 14)))
        price = {"".join(rng.choice("ab") for _ in range(rng.randint(3, 6))): rng.randint(1, 9) for _ in range(25)}
        pieces = [(a, b, price[word[a:b]]) for a in range(len(word)) for b in range(a + 1, len(word) + 1) if b - a < len(word) and word[a:b] in price]
        rng.shuffle(pieces)
        ways = sorted((cost, len(cuts), cuts) for cost, cuts in all_ways(word, price))
        want = (ways[0][0], ways[0][2][:-1]) if ways else None
        assert seg.best_split(len(word), pieces) == want


TEXTS = ["El auxiliar de bodega firma contrato", "auxiliar bodega contrato firma", "Auxiliar, bodega: CONTRATO firma", "AuxiliarBodega y CONTRATOFIRMA — firmacontrato.", "nada que partir", None, "", "auxiliarbodega\n\nbodegacontratofirma áuxiliarbodega"]


def test_texts_against_plain_python(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, "otro auxiliarbodega"), (None, TEXTS[3]), *[(100 + i, "auxiliar bodega contrato firma") for i in range(60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lists = [[w for w in re.split("[^a-z]+", (t or "").lower().translate(ACCENTS)) if w] for _, t in rows]
    n, docs = Counter(w for ws in lists for w in ws), Counter(w for ws in lists for w in set(ws))
    total = sum(n.values())
    cost = {w: round(1000 * (math.log(total) - math.log(c))) for w, c in n.items()}
    price = {w: cost[w] for w in n if 3 <= len(w) <= 9 and docs[w] >= 3}
    parts = {}
    for w in n:
        ways = sorted((c, len(cuts), cuts) for c, cuts in all_ways(w, price)) if len(w) >= 7 else []
        if ways and ways[0][0] < cost[w]:
            marks = [0, *ways[0][2]]
            parts[w] = [w[a:b] for a, b in zip(marks, marks[1:])]
    found = seg.splits(seg.words_of(df)).collect()
    assert {r["word"]: r["parts"] for r in found} == parts
    assert parts["auxiliarbodega"] == ["auxiliar", "bodega"] and parts["bodegacontratofirma"] == ["bodega", "contrato", "firma"]

    out = sorted(map(tuple, seg.cleaned(df, seg.splits(seg.words_of(df))).where("coalesce(doc_id, 0) < 100").collect()), key=repr)
    assert out == sorted([
        (0, TEXTS[0], 0), (1, TEXTS[1], 0), (2, TEXTS[2], 0), (3, "Auxiliar Bodega y CONTRATO FIRMA - firma contrato.", 3), (4, TEXTS[4], 0), (5, None, 0), (6, "", 0),
        (7, "auxiliar bodega\n\nbodega contrato firma áuxiliar bodega", 3), (3, "Auxiliar Bodega y CONTRATO FIRMA - firma contrato.", 3), (3, "otro auxiliar bodega", 1), (None, "Auxiliar Bodega y CONTRATO FIRMA - firma contrato.", 3),
    ], key=repr)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert seg.splits(seg.words_of(none)).collect() == [] and seg.cleaned(none, seg.splits(seg.words_of(none))).collect() == []


def test_words_are_counted_before_they_are_shuffled(spark):
    """One exchange, by word, of partial sums; before, each text's words went through one of their own."""
    df = spark.createDataFrame([(1, "uno dos uno"), (2, "uno"), (3, None)], "doc_id long, text string")
    counts = seg.words_of(df)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counts.collect())) == [("dos", 1, 1), ("uno", 3, 2)]
