"""Packing token streams into training sequences by best-fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
import tiktoken
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import chunks, pick, small_batches, table, texts

#: Tokens that a task gathers before it packs them: its windows are filled from so many.
GATHERED = 2 << 20

#: Fixed split pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of which every Unicode version says the same: Latin, Greek, Cyrillic, common punctuation.
SETTLED = re.compile("[\x00-\x1b\x20-\u052f\u2010-\u2027\u20ac]*").fullmatch
#: Characters of a text from which the tokenizers library encodes it: the other one's pattern may give up on long runs.
LONG = 1 << 19


@lru_cache(2)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(2)
def by_rank(path: str) -> tuple[tiktoken.Encoding | None, tuple[str, ...]]:
    """The vocabulary for a library that merges by the ids of the pieces made, and the strings of special tokens.

    None if that isn't the same: merges have to stand in the order of the ids that they make.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    byte = {x: i for i, x in enumerate(byte_letters())}
    ids = spec["model"]["vocab"]
    made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(made) or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        return None, tuple(special)
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in ids.items() if t not in special}
    return tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian unsigned 32-bit ids, which are those of the tokenizers library.

    Where merges stand in the order of their ids, tiktoken gives the same ids in less than half of the time. A text that
    holds a special token's string, or letters on which Unicode versions disagree, is encoded by the tokenizers library.
    """
    ranked, special = by_rank(path)

    def encode(batch: list[str]) -> list[bytes]:
        return [
            ranked.encode_to_numpy(x, disallowed_special=()).astype("<u4", copy=False).tobytes()
            if ranked and len(x) < LONG and SETTLED(x) and not any(s in x for s in special)
            else np.array(library(path).encode(x, add_special_tokens=False).ids, "<u4").tobytes()
            for x in batch
        ]

    return encode


class OpenWindows:
    """Open windows under a segment tree over remaining capacity; a leaf holds the windows with that much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.most = [-1] * (2 * self.leaves)  # the largest capacity below a node that has a window, or -1
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _update(self, room: int) -> None:
        k = room + self.leaves
        self.most[k] = room if self.at[room] else -1
        while k > 1:
            k //= 2
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        if len(self.at[room]) == 1:
            self._update(room)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least `length`: its number and its room."""
        k = length + self.leaves
        while self.most[k] < length:  # climb until something to the right has a window
            while k % 2 and k > 1:
                k //= 2
            if k <= 1:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.most[2 * k] >= 0 else 2 * k + 1
        room = k - self.leaves
        window = self.at[room].pop()
        if not self.at[room]:
            self._update(room)
        return window, room


def best_fit(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) for documents of these token counts.

    Full windows are cut from overlong documents first; the rest is packed best-fit decreasing. Then the emptiest windows
    are taken apart and cut to fill the gaps of the others, so that at most one window isn't full; that one is cut at
    powers of two, which need no padding.
    """
    full = [[(d, at, size)] for d, n in enumerate(lengths) for at in range(0, n - size + 1, size)]
    rest = sorted(((n % size, d) for d, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    open_, packed, room = OpenWindows(size), [], []
    for length, d in rest:
        if (found := open_.tightest(length)) is None:
            packed.append([])
            room.append(size)
            found = len(packed) - 1, size
        window, left = found
        packed[window].append((d, lengths[d] - length, length))
        room[window] = left - length
        if left > length:
            open_.put(window, left - length)
    order = sorted(range(len(packed)), key=lambda w: (room[w], w))  # the fullest first
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i], order[j]
        if not room[to]:
            i += 1
        elif not packed[source]:
            j -= 1
        else:
            d, start, length = packed[source].pop()
            moved = min(length, room[to])
            packed[to].append((d, start, moved))
            room[to] -= moved
            room[source] += length
            if moved < length:
                packed[source].append((d, start + moved, length - moved))
                room[source] -= length - moved
    tail = []
    for w in (w for w in order if room[w] and packed[w]):
        left, pieces = size - room[w], packed[w][::-1]
        packed[w] = []
        while left:
            power = 1 << (left.bit_length() - 1)
            left -= power
            tail.append([])
            while power:
                d, start, length = pieces.pop()
                taken = min(length, power)
                tail[-1].append((d, start, taken))
                power -= taken
                if taken < length:
                    pieces.append((d, start + taken, length - taken))
    return full + [x for x in packed if x] + tail


KINDS = {"doc_id": "long", "start": "long", "length": "long", "ids": "binary", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}


def pack(docs: DataFrame, vocabulary_file: str, size: int = 1024, end_id: int = 0, digest: bool = False) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row for each piece of a document in a sequence.

    A document is its ids (as of the tokenizers library, without special tokens added) and `end_id`. A sequence holds at most
    `size` tokens; all are full but for the last few that a task packs, whose lengths are powers of two. ids are unsigned
    32-bit little-endian; with `digest`, ids_crc32 stands for them. Each task packs what it reads, up to GATHERED tokens at
    a time, so nothing is shuffled; the sequence's number has the partition in its upper bits.

    Cases: a null text is empty, and an empty document is `end_id` alone. A document longer than a sequence is cut, wherever
    it is. Repeated rows are documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(vocabulary_file)
    name = vocabulary_file.rsplit("/", 1)[-1]
    kinds = {("ids_crc32" if digest and c == "ids" else c): ("long" if digest and c == "ids" else k) for c, k in KINDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(SparkFiles.get(name))
        sequence = TaskContext.get().partitionId() << 36
        end = np.array([end_id], "<u4").tobytes()

        def packed(doc_ids: list[int | None], streams: list[bytes]) -> pa.RecordBatch:
            nonlocal sequence
            counts = np.array([len(x) // 4 for x in streams])
            windows = best_fit(counts.tolist(), size)
            sizes = np.array([len(w) for w in windows])
            doc, start, length = np.array([piece for w in windows for piece in w], np.int64).T
            before = np.cumsum(length) - length
            offset = before - np.repeat(before[np.cumsum(sizes) - sizes], sizes)
            views = [memoryview(x) for x in streams]
            ids = [views[d][a:b] for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())]
            content = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(map(bytes, ids), pa.binary())
            whole = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
            numbers = np.repeat(np.arange(sequence, sequence + len(windows)), sizes)
            sequence += len(windows)
            return pa.RecordBatch.from_arrays([whole, *map(pa.array, (start, length)), content, *map(pa.array, (counts[doc], numbers, offset))], list(kinds))

        doc_ids: list[int | None] = []
        streams: list[bytes] = []
        gathered = 0
        for batch in chunks(batches, "text", 1 << 20):
            doc_ids += batch.column("doc_id").to_pylist()
            new = [x + end for x in encode(texts(batch))]
            streams += new
            gathered += sum(map(len, new)) // 4
            if gathered >= GATHERED:
                yield packed(doc_ids, streams)
                doc_ids, streams, gathered = [], [], 0
        if streams:
            yield packed(doc_ids, streams)

    return pick(docs, "doc_id", "text").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
