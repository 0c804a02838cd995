"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, however the others are called.

    Names are compared exactly, so that an extra column `TEXT` beside `text` (or a second `text`: the first counts) is no
    ambiguity.
    """
    at = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(at))])
    return numbered.select(*[F.col(f"c{at.index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; where it is unset, on one machine (tests), a temporary one."""
    if not (found := spark.sparkContext.getCheckpointDir()):
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Bytes that go to a Python worker in one Arrow batch.
BATCH_CONF, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on, the session's Arrow batches hold BATCH bytes at most, so a worker's input is bounded whatever rows weigh."""
    now = spark.conf.get(BATCH_CONF)
    if int(re.sub(r"\D", "", now)) > BATCH or not now.rstrip("b").isdigit():
        spark.conf.set(BATCH_CONF, str(BATCH))


def stage(df: DataFrame) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again.

    Lineage ends there: a lost executor costs at most the tasks that it ran, and nothing before is computed again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of what is written and done with: it waits for the driver's garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long or string, b likewise): columns node, component (the smallest node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two aggregations and two joins by
    node, no component is ever held by one task, and the number of rounds is logarithmic in the longest chain. Loops and
    repeated edges are allowed; nodes without an edge aren't listed. Null ends are ignored.
    """
    stars = stage(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seal = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = seal(stars)
    while before[0]:
        both = stars.union(stars.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        small = near.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        stars = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
        now = seal(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the batch's texts as one array, without a copy, and where each begins (with one entry more: the end)."""
    column = batch.column(name)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, places, values = column.buffers()
    if not len(column) or values is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    starts = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(values, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def chunks(batches: Iterable[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of the column `name`; a longer text is alone in its batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = utf8(batch, name)[1][:-1] // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            yield batch.slice(at, end - at)


#: Bytes of a text that runs() splits at once.
RUNS = 1 << 20


def kept_bytes(kept: bytes) -> bytes:
    """A table for runs(): A-Z as a-z, `kept` and all bytes of characters beyond ASCII as they are, others as spaces."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c in kept or c >= 128 else 32 for c in range(256))


def runs(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The runs of bytes that `table` keeps, in order, in lists of about RUNS bytes of the text each."""
    text, at = text.translate(table), 0
    while at < len(text):
        end = text.find(b" ", at + RUNS)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


MULTIPLY_A, MULTIPLY_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
WIDTH_A, WIDTH_B = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit values; the order of the two counts."""
    h = x * MULTIPLY_A
    h ^= h >> WIDTH_A
    h += y
    h *= MULTIPLY_B
    h ^= h >> WIDTH_B
    h *= MULTIPLY_A
    h ^= h >> WIDTH_A
    return h


def joined(values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one array, and where each begins (with one entry more: the end)."""
    values = list(values)
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(x) for x in values], out=starts[1:])
    return np.frombuffer(b"".join(values), np.uint8), starts


#: Bytes that end a word: space and U+0009 to U+000D. In UTF-8 no other character has such a byte.
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32


#: Bytes that word_hashes() works on at once; a longer word is worked on as a whole.
SLICE = 1 << 18
#: What a byte adds to its word's hash, before the power of its place.
WORTH = (np.arange(1, 257, dtype=np.uint64) ** np.uint64(2)) * MULTIPLY_B
BASE = 0x100000001B3


@lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: a 64-bit hash, the text's number, first byte, byte after the last, of each word.

    A word is a run of bytes that are no white space of ASCII; no word goes over a text's end. The hash adds up every
    byte times a power of an odd number, by the byte's place in the word, and mixes the sum with the length. The sums are
    differences of running sums over a slice, so besides the words themselves it takes some 24 bytes for each of SLICE.
    """
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data):  # up to white space or the end of a text
            gap = np.flatnonzero(~IS_WORD[data[end : end + SLICE]])
            near = min(end + int(gap[0]) if len(gap) else len(data), int(starts[np.searchsorted(starts, end)]))
            if near <= end + SLICE:
                end = near
                break
            end += SLICE
        end = min(end, len(data))
        own = data[at:end]
        begins = IS_WORD[own]
        inside, ends = begins.copy(), begins.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = starts[np.searchsorted(starts, at, side="right") : np.searchsorted(starts, end)] - at
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(first):
            size = 1 << (len(own) - 1).bit_length()
            sums = WORTH[own]
            sums *= powers(size, BASE)[: len(own)]
            before = sums[first]
            np.cumsum(sums, out=sums)
            total = (sums[last - 1] - sums[first] + before) * powers(size, pow(BASE, -1, 1 << 64))[first]
            parts.append((mix(total, (last - first).astype(np.uint64)), first + at, last + at))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes, first, last = (np.concatenate(x) for x in zip(*parts))
    return hashes, np.searchsorted(starts, first, side="right") - 1, first, last
