"""Texts joined by person, of which no task reads all, against hashlib."""

import hashlib
import random

import pytest

from cedrela.operators import digests
from cedrela.plans import persons as plan


def test_a_hash_is_left_and_taken_up_again():
    lib, data = digests.library(), random.Random(1).randbytes(1000)
    for cut in (0, 1, 63, 64, 65, 127, 999):
        one = digests.Resumable(lib)
        one.update(data[:cut])
        assert one.hexdigest() == hashlib.sha256(data[:cut]).hexdigest()
        two = digests.Resumable(lib, one.state())
        two.update(data[cut:])
        assert two.hexdigest() == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("most", [300, 5000, 1 << 20])
def test_chunks_of_keys_against_hashlib(spark, most):
    """Long and short keys, equal positions, texts longer than a chunk, empty and missing ones."""
    rng = random.Random(most)
    docs = [(i, rng.randrange(150) - 40, rng.choice([None, "", "é", "a\n\nb" * 5, "x" * rng.randrange(60), "y" * 700 if i % 40 == 0 else "z"])) for i in range(400)]
    groups = {i: rng.choice("aaaaaaaabbbbcd") if i % 9 else f"own {i}" for i, _, _ in docs}
    want = {}
    for i, pos, text in sorted((d for d in docs if d[2] is not None), key=lambda d: (d[1], d[2])):
        want.setdefault(groups[i], []).append(text)
    out = digests.joined_sha256(spark.createDataFrame(docs, "id long, pos long, text string"), spark.createDataFrame(list(groups.items()), "id long, g string"), "id", "g", "text", most)
    assert sorted(tuple(r) for r in out.collect()) == sorted((k, hashlib.sha256("\n\n".join(x).encode()).hexdigest()) for k, x in want.items())


def test_without_the_library_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(digests, "library", lambda: None)
    out = digests.joined_sha256(spark.createDataFrame([(1, 1, "a" * 50), (2, 2, "b" * 50)], "id long, pos long, text string"), spark.createDataFrame([(1, "g"), (2, "g")], "id long, g string"), "id", "g", "text", 60)
    assert [tuple(r) for r in out.collect()] == [("g", hashlib.sha256(b"a" * 50 + b"\n\n" + b"b" * 50).hexdigest())]


def test_a_person_is_in_no_task_whole(spark, tmp_path, monkeypatch):
    """Before, one task gathered all texts of a person."""
    rng = random.Random(3)
    rows = [(i, f"ana prueba lopez {rng.randbytes(5000).hex()}", "es", "a", 10_000) for i in range(400)] + [(1000, None, "es", "a", 0), (1001, "luis otro diaz", "de", None, 5), (1002, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    chunk, seen, hashed = 500_000, [], digests.hashed
    monkeypatch.setattr(digests.joined_sha256, "__defaults__", (chunk,))
    monkeypatch.setattr(digests, "hashed", lambda df, key, *more: seen.append({r[0]: r[1] for r in df.groupBy(key).agg({"text": "count"}).collect()}) or hashed(df, key, *more))
    got = {r["group"]: r for r in plan.person_synthesis_documents(spark, str(tmp_path)).collect()}
    ana = got["name:ana lopez prueba"]
    assert ana["n"] == 400 and ana["text_sha256"] == hashlib.sha256("\n\n".join(r[1] for r in rows[:400]).encode()).hexdigest()
    assert got["id:5"]["text_sha256"] == hashlib.sha256(b"luis otro diaz").hexdigest() and got["sin identificar"]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    each = [x["name:ana lopez prueba"] for x in seen]
    assert sum(each) == 400 and len(each) == 8 and max(each) <= chunk // 10_000 + 1
