"""Removal of repeated byte strings: blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, forget, joined, mix, pick, stage, table, texts

#: Length of the strings. Two suffixes tie when they share so many bytes.
LENGTH = 100
#: A difference cover modulo PERIOD: every difference of two positions is one of two of its members.
PERIOD, COVER = 57, np.array([0, 1, 3, 13, 32, 36, 43, 52])
#: Bytes that a cover sample is ranked by: any two tied suffixes have a pair of tied samples in their first PERIOD places.
SAMPLE = LENGTH - PERIOD + 1
#: Bytes of text of a block, and entries of a suffix bucket on average.
BLOCK, BUCKET = 4 << 20, 4_000_000
#: One window in so many ends a segment.
SEGMENT = np.uint64(32)


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), strides=(1,)).copy()


def hashed(words: Callable[[int], np.ndarray], length: int) -> np.ndarray:
    """A hash of `length` bytes (at least 8), given the eight bytes at an offset."""
    out = words(0)
    for k in [*range(8, length - 8, 8), length - 8]:
        out = mix(out, words(k))
    return out


def samples(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cover samples of all texts, and their hashes."""
    longest = int(np.diff(starts).max(initial=0))
    cover = (np.arange(0, longest + PERIOD, PERIOD)[:, None] + COVER).ravel()
    counts = np.searchsorted(cover, np.diff(starts) - SAMPLE, side="right")
    at = [cover[:n] + s for n, s in zip(counts, starts[:-1]) if n]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.concatenate(at)
    words = words_at(data)
    return at, hashed(lambda k: words[at + k], SAMPLE)


class Candidates:
    """The windows (suffixes cut at LENGTH bytes) of a block that have a tied cover sample, with their hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, tied: np.ndarray):
        text = np.searchsorted(starts, tied, side="right") - 1
        first = np.maximum(tied - PERIOD + 1, starts[text])
        last = np.minimum(tied, starts[text + 1] - LENGTH)
        first, last = first[last >= first], last[last >= first]
        new = np.flatnonzero(np.append(True, first[1:] > last[:-1] + 1)) if len(first) else np.zeros(0, int)
        first, last = first[new], last[np.append(new[1:] - 1, len(last) - 1)] if len(new) else last
        counts = last - first + 1
        zone = np.concatenate([data[a : b + LENGTH] for a, b in zip(first, last)]) if len(first) else data[:0]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = inside + np.repeat(first, counts)
        h = words_at(zone)
        for k in (8, 16, 32):
            h = mix(h[:-k], h[k:])
        h = mix(h[: -(LENGTH - 64)], h[LENGTH - 64 :]) if len(h) else h
        room = counts + LENGTH - 1
        self.hash = h[inside + np.repeat(np.cumsum(room) - room, counts)] if len(h) else h
        cut = (self.hash % SEGMENT == 0) | (inside == 0)
        self.begin = np.flatnonzero(cut)
        size = np.diff(np.append(self.begin, len(cut)))
        place = np.arange(len(cut)) - np.repeat(self.begin, size)
        self.size = size
        self.segment = mix(np.add.reduceat(mix(self.hash, place.astype(np.uint64)), self.begin), size.astype(np.uint64)) if len(size) else self.hash[:0]


class Keys:
    """A block's keys in order, once each, and which of them each entry has and which entry is the first."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.first, self.of, self.count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        self.later = np.ones(len(keys), bool)
        self.later[self.first] = False


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def flags(answer: list[dict] | None, n: int) -> np.ndarray:
    """What the buckets said of a block's n keys."""
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in answer or []]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(n, bool)


class Block:
    """A block of documents with the answers so far."""

    def __init__(self, row: dict):
        self.block, self.ids, self.text = row["block"], row["ids"], row["text"]
        self.data = np.frombuffer(self.text, np.uint8)
        self.starts = np.append(0, np.cumsum(row["sizes"])).astype(np.int64)
        self.answers = [row.get(f"answer{k}") for k in range(3)]

    def samples(self) -> tuple[np.ndarray, Keys]:
        at, h = samples(self.data, self.starts)
        return at, Keys(h)

    def candidates(self) -> Candidates:
        at, keys = self.samples()
        tied = flags(self.answers[0], len(keys.keys)) | (keys.count > 1)
        return Candidates(self.data, self.starts, at[tied[keys.of]])

    def open_windows(self) -> tuple[Candidates, np.ndarray, Keys]:
        """The candidates; which are in a segment that stands earlier as a whole; the keys of the others."""
        found = self.candidates()
        keys = Keys(found.segment)
        whole = np.repeat(flags(self.answers[1], len(keys.keys))[keys.of] | keys.later, found.size)
        return found, whole, Keys(found.hash[~whole])

    def repeated(self) -> np.ndarray:
        """The places of windows that also start earlier."""
        found, whole, keys = self.open_windows()
        whole[~whole] = flags(self.answers[2], len(keys.keys))[keys.of] | keys.later
        return found.at[whole]

    def spans(self) -> Iterator[tuple[int | None, bytes, list[tuple[int, int]]]]:
        """Each document with its bytes and its maximal runs of removed bytes."""
        at = self.repeated()
        new = np.append(True, at[1:] > at[:-1] + LENGTH) if len(at) else np.zeros(0, bool)
        text = np.searchsorted(self.starts, at, side="right")
        if len(at):
            new[1:] |= text[1:] != text[:-1]
        begin = np.flatnonzero(new)
        first, past, text = at[begin], at[np.append(begin[1:] - 1, len(at) - 1)] + LENGTH if len(at) else at, text[begin]
        cuts = np.searchsorted(text, np.arange(1, len(self.ids) + 2))
        for d, (i, j) in enumerate(zip(cuts, cuts[1:])):
            a, b = int(self.starts[d]), int(self.starts[d + 1])
            yield self.ids[d], self.text[a:b], [(int(x) - a, int(y) - a) for x, y in zip(first[i:j], past[i:j])]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block({c: batch.column(c)[k].as_py() for c in batch.schema.names})


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, ids, sizes, text: documents in the order of doc_id, BLOCK bytes or one longer document in a block. The block's
    number has the range of doc_id in its upper bits, so blocks are in order, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", BLOCK):
            values = [x.encode("utf-8", "surrogatepass") for x in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([[len(x) for x in values]], pa.list_(pa.int64())), pa.array([b"".join(values)], pa.binary())],
                ["block", "ids", "sizes", "text"],
            )
            block += 1

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return in_order.mapInArrow(run, "block long, ids array<long>, sizes array<long>, text binary")


def ask(blocks: DataFrame, keys: Callable[[Block], Keys], n_buckets: int, short: bool, both: bool) -> DataFrame:
    """block, answer: for each bucket in order, a bit for each of the block's keys.

    The keys of a block are dealt into buckets by their upper bits, a row for each; every bucket is sorted by itself. A bit
    says that the key is also in an earlier block (both: in any other block). short: half of the bits of a key are enough,
    where a wrong answer costs time only. A key is sent once by a block, however often it stands there.
    """
    width = "<u4" if short else "<u8"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches):
            own = keys(block).keys
            cuts = np.searchsorted(bucket_of(own, n_buckets), np.arange(n_buckets + 1))
            sent = (own & np.uint64(0xFFFFFFFF)).astype(width) if short else own
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(np.full(len(some), block.block)), pa.array([sent[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())],
                ["bucket", "block", "keys"],
            )

    def sort_bucket(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        own = [np.frombuffer(x.as_buffer(), width) for x in rows["keys"]]
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        tied = np.zeros(len(every), np.uint8)
        tied[order[1:][same]] = 1
        if both:
            tied[order[:-1][same]] = 1
        parts = np.split(tied, np.cumsum([len(x) for x in own])[:-1])
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "n": pa.array([len(x) for x in own], pa.int32()), "bits": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    sent = blocks.mapInArrow(send, "bucket long, block long, keys binary")
    said = stage(sent.groupBy("bucket").applyInArrow(sort_bucket, "block long, bucket long, n int, bits binary"))
    forget(blocks.sparkSession)
    return said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answer"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes), kept (the remaining bytes' SHA-256) of every document.

    A byte is removed if a string of LENGTH bytes covers it that also starts earlier: in a document with a smaller doc_id, or
    earlier in the same. Matches never cross documents; strings are judged on the input.

    1. The documents are put in order of doc_id and cut into blocks, once, as a table bucketed by block: no later step
       shuffles a text.
    2. The samples of a difference cover are ranked, bucket by bucket. Only suffixes with a tied sample can be tied; the
       rest, most of the text, is done with.
    3. Stretches of suffixes between places chosen by content that stand earlier as a whole are decided at once: of a group
       of copies only the first goes on.
    4. The suffixes left are sorted by their first LENGTH bytes (64-bit hashes), one bucket at a time.

    A block gives each key once and gets a bit for each, so no group of copies meets in one task, and a bucket's size is
    bounded by BUCKET on average.

    Cases: a null text is empty. Texts under LENGTH bytes lose nothing. A null doc_id counts as the smallest. Rows with equal
    doc_id are in an order of Spark's choice, which the written table fixes. Texts are processed whole, a long one in a
    block of its own. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks_of(pick(docs, "doc_id", "text")).write.option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    forget(spark)
    blocks = spark.table(name)
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_buckets = math.ceil(size * len(COVER) / PERIOD / BUCKET) or 1

    with_answers = blocks
    steps = [
        (lambda b: b.samples()[1], True, True),
        (lambda b: Keys(b.candidates().segment), False, False),
        (lambda b: b.open_windows()[2], False, False),
    ]
    for k, (keys, short, both) in enumerate(steps):
        said = ask(with_answers, keys, n_buckets, short, both).withColumnRenamed("answer", f"answer{k}")
        with_answers = with_answers.join(said.hint("shuffle_hash"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in rows_of(batches):
            out = []
            for doc_id, text, spans in block.spans():
                kept, past = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[past:a])
                    past = b
                kept.update(text[past:])
                out.append((doc_id, len(text), [{"start": a, "end": b} for a, b in spans], kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    out = stage(with_answers.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string"))
    spark.sql(f"DROP TABLE {name}")
    forget(spark)
    return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
