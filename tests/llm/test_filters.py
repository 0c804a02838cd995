"""Co-training and the perplexity band against plain loops, disclosure by entity frequency, and names that clash."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedrela.llm import perplexity, pii, quality

from .test_texts import brute_kneser_ney, expected_spans

SF = "/root/testdata/sf0.01"


def plain_logistic(x, y, ridge):
    """Ridge logistic regression by small steps of descent, one row after the other in plain Python sums."""
    w = np.zeros(x.shape[1] + 1)
    z = [np.append(r, 1.0) for r in x]
    keep = np.append(np.full(x.shape[1], ridge), 1e-3)
    top = np.linalg.eigvalsh(sum(np.outer(r, r) for r in z) / 4 + np.diag(keep)).max()
    past = w
    for k in range(20_000):  # accelerated descent
        at = w + k / (k + 3) * (w - past)
        step = sum((1 / (1 + np.exp(-r @ at)) - t) * r for r, t in zip(z, y)) + keep * at
        past, w = w, at - step / top
        if np.abs(step).max() < 1e-7:
            break
    return w


def test_co_training_against_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 2)
    monkeypatch.setattr(quality, "EXCHANGED", 6)
    monkeypatch.setattr(quality, "SURE", 0.7)
    rng = np.random.default_rng(3)
    y = (rng.random(50) < 0.5).astype(float)
    text, meta = rng.normal(size=(50, 3)) + y[:, None], rng.normal(size=(50, 2)) + y[:, None]
    pool = (rng.random(30) < 0.5).astype(float)
    pool_text, pool_meta = rng.normal(size=(30, 3)) + pool[:, None], rng.normal(size=(30, 2)) + pool[:, None]
    got = quality.co_train(text, meta, y, pool_text, pool_meta)

    views, taken = [(text, pool_text), (meta, pool_meta)], [{}, {}]
    train = [i for i in range(50) if i % 5 != 4]
    for _ in range(2):
        fitted = []
        for (own, more), extra in zip(views, taken):
            x = np.array([own[i] for i in train] + [more[i] for i in extra])
            t = [y[i] for i in train] + list(extra.values())
            mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
            w = plain_logistic(np.clip((x - mean) / spread, -8, 8), t, 5.0)
            fitted.append(lambda r, m=mean, s=spread, w=w: np.clip((r - m) / s, -8, 8) @ w[:-1] + w[-1])
        for i in (0, 1):
            p = [1 / (1 + np.exp(-fitted[i](r))) for r in views[i][1]]
            for label, sure in ((1, p), (0, [1 - q for q in p])):
                for k in sorted(range(30), key=lambda k: (-sure[k], k))[:6]:
                    if sure[k] >= 0.7:
                        taken[1 - i].setdefault(k, label)
    assert all(taken)
    held = [i for i in range(50) if i % 5 == 4]
    logits = []
    for f, (own, _) in zip(fitted, views):
        slope, shift = plain_logistic(np.array([[f(own[i])] for i in held]), [y[i] for i in held], 1.0)
        logits.append(np.array([slope * f(r) + shift for r in own]))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    a, b, both = got.score(text, meta)
    prior = np.log(y.mean() / (1 - y.mean()))
    assert np.allclose(a, sigmoid(logits[0]), atol=1e-4) and np.allclose(b, sigmoid(logits[1]), atol=1e-4)
    assert np.allclose(both, sigmoid(logits[0] + logits[1] - prior), atol=1e-4)


def test_query_scores_every_document_with_the_fitted_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.op3_quality_classifier(spark, SF).collect()}
    rows = docs.collect()
    assert got.keys() == {r["doc_id"] for r in rows}
    for r in rows[::25]:
        view = quality.text_view([r["text"] or ""]), quality.meta_view([r["lang"]], [r["source"]], [r["n_chars"]])
        a, b, both = (float(x[0]) for x in model.score(*view))
        g = got[r["doc_id"]]
        assert np.allclose([g["p_text"], g["p_meta"], g["score"]], [a, b, both], atol=1e-9) and g["kept"] == (both >= quality.THRESHOLD)


def test_band_of_each_language_against_plain_sums(spark):
    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    text = lambda n: " ".join(f"{words[rng.integers(5)]}{rng.integers(40)}" for _ in range(n))
    rows = [(i, text(int(rng.integers(5, 50))), None if i % 9 == 0 else "de" if i % 2 else "en") for i in range(80)]
    rows += [(100, " ".join("zqxj" for _ in range(40)), "de"), (101, " ".join(f"Ж{i}щ" for i in range(60)), "en"), (102, "", "fr"), (103, None, "fr"), (104, "few words", "fr")]
    got = {r["doc_id"]: r for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for lang in ("de", "en", "", "fr"):
        own = [(i, t or "") for i, t, x in rows if (x or "") == lang]
        log_p = brute_kneser_ney([list(map(ord, t)) for _, t in own])
        entropy = {i: -log_p(list(map(ord, t))) / (len(t) + 1) for i, t in own}
        passed = sorted(entropy[i] for i, _ in own if not got[i]["base_failed"])
        for i, _ in own:
            assert got[i]["perplexity"] == pytest.approx(np.exp(entropy[i]), rel=1e-4)
        if not passed:
            assert not any(got[i]["kept"] for i, _ in own)
            continue
        q = [passed[int(np.ceil(len(passed) * p)) - 1] for p in (0.25, 0.75)]
        width = max(q[1] - q[0], 0.01) * perplexity.SPREAD
        for i, _ in own:
            if min(abs(entropy[i] - q[0] + width), abs(entropy[i] - q[1] - width)) > 1e-4:
                assert got[i]["kept"] == (not got[i]["base_failed"] and q[0] - width <= entropy[i] <= q[1] + width), i
    assert not got[101]["kept"]


def test_a_frequent_entity_does_not_flag_its_neighbours(spark):
    often = [(i, f"menta{i % 3} contact desk@often.example.org") for i in range(60)]
    seldom = [(100 + i, "Zanzibarian wrote ann@rare.example.org") for i in range(3)]
    got = {r["doc_id"]: r["_spans"] for r in pii.find(spark.createDataFrame(often + seldom, "doc_id long, text string")).collect()}
    assert got[0] == "email:15:37"  # it stands in 60 of 63 documents: contact tells nothing new
    assert got[100] == "removed:0:11,removed:12:17,email:18:38"


def test_pii_query_and_both_ways_to_hold_terms(spark, monkeypatch):
    got = {r["doc_id"]: r for r in pii.op7_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = expected_spans(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for _, _, x in spans) for k in pii.KINDS]
    monkeypatch.setattr(pii, "TERM_PART", 0)
    assert {r["doc_id"]: r["spans"] for r in pii.op7_pii(spark, SF).collect()} == {k: r["spans"] for k, r in got.items()}


def test_names_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("*", *[F.lit("z").alias(c) for c in ("_p", "_KEPT", "_spans", "_sanitised", "terms", "row", "c0", "TEXT")])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() <= 60
    assert quality.classify(docs, labels).columns == [c for c in docs.columns if c not in ("_p", "_KEPT")] + list(quality.SCORES)
    clean = pii.clean_documents(docs)
    assert clean.columns == docs.columns and clean.where("_spans = 'z' AND TERMS = 'z'").count() == 60
    assert pii.find(docs).columns == [c for c in docs.columns if c not in pii.FOUND] + list(pii.FOUND)


def test_pseudo_labels_come_from_all_documents_without_a_label(spark, monkeypatch):
    """Each view's surest, over every document, against sorting them all; copies count once, labelled ones don't."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(docs.limit(40)).union(spark.createDataFrame([(None, "free text", None, None, None), (None, None, "en", "s", 3)], docs.schema)).repartition(7)
    known = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rng = np.random.default_rng(8)
    width = quality.text_view(["a b"]).shape[1], quality.meta_view(["a"], ["b"], [1]).shape[1]
    fitted = [quality.View(np.zeros(n), np.ones(n), rng.normal(size=n + 1) * 3) for n in width]
    labelled = {r["doc_id"] for r in known.collect()}
    keyed = docs.withColumn("key", F.xxhash64(*docs.columns)).collect()
    rows = {tuple(r)[:-1]: r["key"] for r in keyed if r["doc_id"] not in labelled}
    place = {key: i for i, key in enumerate(rows.values())}
    x = [quality.text_view([r[1] or "" for r in rows]).astype("<f4"), quality.meta_view(*([r[i] for r in rows] for i in (2, 3, 4))).astype("<f4")]
    longest = 0
    for limit in (quality.MAX_KNOWN, 0):
        monkeypatch.setattr(quality, "MAX_KNOWN", limit)
        found = quality.surest_of(quality.unlabelled(docs, known), fitted)
        for i in (0, 1):
            p = quality.sigmoid(fitted[i].logit(x[i]))
            for label, sure in ((1, p), (0, 1 - p)):
                want = sorted(-s for s in sure if s >= quality.SURE)[: quality.EXCHANGED]
                got = found.get((i, label), [])
                assert len(got) == len(want) == len({k for k, _ in got})
                mine = [float(sure[place[k]]) for k, _ in got]
                assert all(np.array_equal(x[1 - i][place[k]], row) for k, row in got)
                longest = max(longest, len(want))
                assert np.allclose(sorted(-s for s in mine), want, atol=1e-6)
    assert longest == quality.EXCHANGED
