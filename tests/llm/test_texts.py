"""Operators on single texts against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cedrela.llm import ann, bpe, line_dedup, packing, perplexity, pii, quality

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string, sequence_id int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [None, "", " \n ", "é", rows[0], rows[0], "a b c d e f g h " * 5, "x" * 70_000, "Σας İ Ñ́ <|endoftext|> 名前 \x85", "word " * 30_000]
    return [(i, t, "en" if i % 3 else None, f"s{i % 7}", None if t is None else len(t), "r", 1) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def frame(spark, docs):
    df = spark.createDataFrame(docs + [docs[3]], SCHEMA).repartition(3).select("*", F.lit("other").alias("TEXT"))
    return df.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(frame, nothing, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe.encode_decode(frame, path).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([d[0] for d in docs] + [3])
    for r in got:
        ids = t.encode(docs[r["doc_id"]][1] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), " ".join(map(str, ids)))
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(nothing, path).count() == 0


def test_packing(frame, nothing, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(frame, path).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["length"] == len(r["ids"]) // 4 > 0
    for d in docs:
        ids = [*t.encode(d[1] or "", add_special_tokens=False).ids, 0]
        pieces = sorted(of[d[0]], key=lambda r: r["start"])
        if d[0] == 3:  # twice in the input
            assert sum(r["length"] for r in pieces) == 2 * len(ids)
            continue
        assert b"".join(r["ids"] for r in pieces) == np.array(ids, "<u4").tobytes()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(nothing, path).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    windows = packing.OpenWindows(50)
    plain = []
    for i in range(400):
        length = rng.randint(1, 50)
        fits = [r for r in plain if r >= length]
        found = windows.tightest(length)
        assert (found[1] if found else None) == (min(fits) if fits else None)
        if found:
            plain.remove(found[1])
        room = rng.randint(1, 50)
        windows.put(i, room)
        plain.append(room)


def expected_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules_base(frame, nothing, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: r for r in perplexity.judge(frame).collect()}
    for d in docs:
        r, want = got[d[0]], expected_base(d[1])
        assert tuple(r[x] for x in names) == want, d[0]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert perplexity.judge(nothing).count() == 0


def brute_kneser_ney(texts):
    """Modified Kneser-Ney of order 4 by its definition, with dictionaries."""
    counts = [Counter() for _ in range(5)]
    for t in texts:
        s = [-1, -1, -1, *t, -2]
        counts[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for o in (3, 2, 1):
        counts[o].update(g[1:] for g in counts[o + 1])

    def off(o, n):
        t = [sum(c == k for c in counts[o].values()) for k in range(5)]
        k = min(n, 3)
        d = k - (k + 1) * (t[1] / (t[1] + 2 * t[2])) * t[k + 1] / t[k] if t[k] and t[1] + 2 * t[2] else -1
        return d if 0 < d < k else k / 2

    offs = [{n: off(o, n) for n in set(counts[o].values())} for o in range(5)]
    total, left = Counter(), Counter()
    for o in range(1, 5):
        for g, n in counts[o].items():
            total[o, g[:-1]] += n
            left[o, g[:-1]] += offs[o][n]

    def p(g):
        o = len(g)
        if not o:
            return 1 / (len(counts[1]) + 1)
        h = o, g[:-1]
        if h not in total:
            return p(g[1:])
        n = counts[o][g]
        return (n - offs[o][n] if n else 0) / total[h] + left[h] / total[h] * p(g[1:])

    def log_p(t):
        s = [-1, -1, -1, *t, -2]
        return sum(np.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s)))

    return log_p


def test_kneser_ney(spark):
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    new = ["abcd", "ddddaaaaéé", ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(known)], "doc_id long, text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_grams(df)).cache()
    log_p = brute_kneser_ney([list(map(ord, t)) for t in known])
    other = spark.createDataFrame([(i, t, "x") for i, t in enumerate(known + new)], "doc_id long, text string, lang string")
    whole = {r["doc_id"]: r["log_p"] for r in perplexity.score(other, model).collect()}
    limit, perplexity.MODEL_PART = perplexity.MODEL_PART, 100
    try:
        parts = {r["doc_id"]: r["log_p"] for r in perplexity.score(other, model).collect()}
    finally:
        perplexity.MODEL_PART = limit
    for i, t in enumerate(known + new):
        want = log_p(list(map(ord, t)))
        assert abs(whole[i] - want) < 1e-3 + 1e-5 * abs(want), t
        assert abs(parts[i] - want) < 1e-3 + 1e-5 * abs(want), t


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def expected_spans(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def card(s):
        d = digits(s)[::-1]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if card(m[0])]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_pii_patterns():
    rng = random.Random(5)
    for alphabet in ("a.@-", "12.0", "0123456789 -+", "+1 (.)-2@a", "é@a.1 "):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == expected_spans(t), t
    assert pii.base_spans("4111 1111 1111 1111")[0][2] == "card"
    pii.base_spans("a" * 300_000 + "1" * 300_000 + "+" * 100_000 + "@" * 100_000)  # linear


def test_context_has_no_window_of_characters():
    mail, far = "ana.prueba@example.org", " 12" * 100
    text = f"uno zeroth first{far} second third fourth fifth sixth {mail}{far} eleventh twelfth " + "x" * 300 + f"{far} fourteenth"
    near = {"first", "second", "third", "fourth", "fifth", "sixth", "eleventh", "twelfth", "x" * 300, "fourteenth"}
    assert pii.beside(text, pii.base_spans(text)) == {(w, f"email:{mail}") for w in near}


def test_pii_terms(spark, nothing):
    rows = [(i, f"the quiet Zanzibarian wrote from ann@site{i % 2}.example.org with common words {i}") for i in range(4)]
    rows += [(10 + i, "the quiet common words wrote with from nothing else") for i in range(20)]
    rows += [(40, "here Zanzibarian stands alone"), (41, None), (42, "")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("TEXT"))).collect()}
    assert got[40]["_spans"] == ""  # two entities share the term: neither is told
    assert got[41]["_sanitised"] is None and got[42]["_sanitised"] == ""
    rows = [(i, t.replace("site1", "site0") if t else t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert got[40]["_spans"] == "general:5:16" and got[40]["_sanitised"] == "here [term] stands alone"
    assert got[0]["_spans"].startswith("general:10:21,email:") and "[email]" in got[0]["_sanitised"]
    limit, pii.TERM_PART = pii.TERM_PART, 1
    try:
        assert {r["doc_id"]: r["_spans"] for r in pii.find(df).collect()} == {k: r["_spans"] for k, r in got.items()}
    finally:
        pii.TERM_PART = limit
    assert pii.find(nothing).count() == 0


def test_pii_terms_whose_lower_case_is_longer(spark):
    """A dotted capital I is two code points in lower case; the term is the same wherever it stands, and whichever way terms are held."""
    rows = [(i, f"İlbankası ann{0}@site.example.org {i} ΣΑΣ'Α") for i in range(4)] + [(10 + i, "nothing of the kind here") for i in range(20)] + [(40, "ask İlbankası alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    limit = pii.TERM_PART
    try:
        for pii.TERM_PART in (limit, 0):
            got = {r["doc_id"]: r for r in pii.find(df).collect()}
            assert got[40]["_spans"] == "general:4:13" and got[40]["_sanitised"] == "ask [term] alone"
            assert got[0]["_spans"].startswith("general:0:9,email:10:") and got[10]["_spans"] == ""
    finally:
        pii.TERM_PART = limit


def test_line_dedup(spark, frame, nothing, docs):
    lines = [(i, f"shared\n own {i}\n\nshared\n{'long' if i < 8 else 'short'}", None, f"s{i % 9}" if i else None, 1, "r", 1) for i in range(40)]
    lines += [(99, None, None, None, None, None, None), (100, "", None, "s1", 0, None, None)]
    got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(spark.createDataFrame(lines, SCHEMA), 8).collect()}
    assert got[0]["removed"] == [3] and got[5]["removed"] == [0, 3]
    assert got[5]["kept_text"] == " own 5\n\nlong"  # on seven sites only
    assert got[9]["removed"] == [0, 3, 4] and got[99]["kept_text"] == "" and got[99]["n_lines"] == 0
    out = line_dedup.clean_documents(spark.createDataFrame(lines, SCHEMA), 8)
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")] and out.count() == 42
    assert line_dedup.without_boilerplate(nothing).count() == 0
    assert line_dedup.without_boilerplate(frame).count() == len(docs) + 1


def test_quality_classifier(spark, frame, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    known = labels.where("doc_id % 3 != 0")
    out = quality.classify(docs, known).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((out["_p"] >= 0.5) == (out["quality"] == 1)).mean() > 0.95  # held out
    got = quality.classify(frame.toDF(*frame.columns[:-1], "more"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.where("_kept").count() == frame.count()
    assert quality.classify(nothing, labels).count() == 0


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows[20] = (20, rows[0][1])
    rows += [(1000 + i, [1.0] * 8) for i in range(100)]
    bad = [(2000, None), (2050, [0.0] * 8), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2005, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for tile in (4096, 64):
        limit, ann.CANDIDATES = ann.CANDIDATES, tile
        got = defaultdict(list)
        try:
            for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
                got[r["query_id"]].append((r["vec_id"], r["score"]))
        finally:
            ann.CANDIDATES = limit
        assert set(got) == {i for i in vectors if i % 50 == 0}
        for q, found in got.items():
            want = sorted((-float((vectors[q] * v).sum() / (np.sqrt((vectors[q] ** 2).sum()) * np.sqrt((v**2).sum()))), i) for i, v in vectors.items() if i != q)[:5]
            assert [i for _, i in want] == [i for i, _ in found]
            assert np.allclose([-s for s, _ in want], [s for _, s in found], atol=1e-14)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(few, F.col("vec_id") % 50 == 0).count() == 1
    assert ann.nearest(few.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
