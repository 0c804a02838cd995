"""The pipeline's stages against plain Python, each on its own input."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cedrela.llm import line_dedup, pii

from .test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        steps[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        return docs.collect()

    kept = run("quality classifier")
    assert docs.columns == columns and {tuple(r) for r in kept} <= {tuple(r) for r in before.values()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 400").collect()}
    left = {r["doc_id"] for r in kept}
    assert np.mean([(d in left) == (q == 1) for d, q in quality.items()]) > 0.97

    sites, first = defaultdict(set), {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        for i, x in enumerate(r["text"].split("\n")):
            sites[x.strip(" ")].add(r["source"])
            first.setdefault(x.strip(" "), (r["doc_id"], i))
    lines = {r["doc_id"]: r for r in run("line dedup")}
    assert docs.columns == columns and len(lines) == len(kept)
    for r in kept:
        stays = lambda i, x: not x or len(sites[x]) < line_dedup.MIN_SITES or first[x] == (r["doc_id"], i)
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if stays(i, x.strip(" ")))
        assert lines[r["doc_id"]]["text"] == text

    groups = brute([(r["doc_id"], r["text"]) for r in lines.values()])
    single = run("n-gram Jaccard join")
    assert docs.columns == columns and sorted(r["doc_id"] for r in single) == sorted({c for _, _, c in groups})
    assert all(tuple(r) == tuple(lines[r["doc_id"]]) for r in single)

    clean = {r["doc_id"]: r for r in run("personal data")}
    assert docs.columns == columns and len(clean) == len(single)
    for r in single:
        now = clean[r["doc_id"]]
        assert now["n_chars"] == len(now["text"]) or now["text"] == r["text"]
        for a, b, _ in pii.base_spans(r["text"]):
            assert r["text"][a:b] not in now["text"]

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in run("packing"):
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(clean)
    for d, rows in pieces.items():
        ids = np.frombuffer(b"".join(r["ids"] for r in sorted(rows, key=lambda r: r["start"])), "<u4")
        assert ids.tolist() == [*t.encode(clean[d]["text"], add_special_tokens=False).ids, 0]


def test_rows_go_as_near_duplicates_only(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, one), (7, one), (7, two), (7, two), (None, one), (None, "c d e f g h"), (None, "c d e f g h"), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.duplicate_stage(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(5, one), (7, two), (None, "c d e f g h"), (8, ""), (8, "")], key=repr)


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
