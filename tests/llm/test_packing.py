"""Ids against the tokenizers library, and the registered query against the contract."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cedrela.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizers_library():
    rng = random.Random(4)
    alphabets = ["a", "ab", "aeinst", "e ", "-=_.", "\n \t\r", "0123²½", "é ü'", "etaoin shrdlu", "I'll 'S don't'", "日本 語の", "\x00\x01ab\x1c\x1f", "\x85\xa0 a ", "АБвгд ё", "<|endoftext|> a", "😀a "]
    values = ["".join(rng.choice(x) for _ in range(rng.randint(0, 60))) for x in alphabets for _ in range(300)]
    values += ["", "<|endoftext|>", "a<|endoftext|>b ", "a" * 50_000, " " * 50_000 + "x", "\n" * 20_000, "word " * 20_000, "ab" * packing.LONG]
    library = Tokenizer.from_file(PATH)
    assert packing.by_rank(PATH)[0] is not None
    for x, got in zip(values, packing.encoder(PATH)(values)):
        assert got == np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x[:80]


def test_query_keeps_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = Tokenizer.from_file(PATH)
    got = packing.op8_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got.collect():
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert docs.keys() == texts.keys()
    for d, rows in docs.items():
        ids, at = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        used += at if at & (at - 1) == 0 else 1024
    assert used == sum(rows[0]["doc_tokens"] for rows in docs.values())  # no padding
