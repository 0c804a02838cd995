"""The registered query against the tokenizers library, with a cache that forgets."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from cedrela.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_query_keeps_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = bpe.op10_bpe(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == len(rows)
    for r in got.collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_pieces_are_the_same_when_words_are_forgotten(monkeypatch):
    v = bpe.vocabulary(PATH)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    small, library = bpe.Pieces(v), Tokenizer.from_file(PATH)
    for k in range(30):
        words = {f"word{chr(97 + (i * k) % 26)}" for i in range(6)} | {"tokenization", "<|endoftext|>"}
        ids, decoded = small.of(words)
        assert len(small.now[0]) < 25
        for w in words - v.special.keys():
            want = library.encode(w, add_special_tokens=False).ids
            assert ids[w] == " ".join(map(str, want)) and decoded[w].split(" ") == [v.piece[i] for i in want]
