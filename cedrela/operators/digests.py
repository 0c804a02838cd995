"""SHA-256 of texts joined by key, where a key's texts may be more than one task should read."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .persons import written

#: Bytes of a key's texts that a task reads at most, besides the end of the last text.
CHUNK = 64 << 20
BETWEEN = b"\n\n"


def library() -> ctypes.CDLL | None:
    """The libcrypto that Python's hashlib has loaded, if its SHA-256 can be left and taken up again."""
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes, lib.SHA256_Update.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_void_p], [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t], [ctypes.c_void_p] * 2
    except (OSError, AttributeError):
        return None
    return lib


class Resumable:
    """SHA-256 that goes on from the state of an earlier one."""

    STATE = 112  # fixed by OpenSSL: SHA256_CTX

    def __init__(self, lib: ctypes.CDLL, state: bytes | None = None) -> None:
        self.lib, self.context = lib, ctypes.create_string_buffer(state or bytes(self.STATE), self.STATE)
        if not state:
            lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, len(data))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.context.raw, self.STATE)
        self.lib.SHA256_Final(out, end)
        return out.raw.hex()


def chunk_starts(sizes: DataFrame, key: str, most: int) -> DataFrame:
    """key, starts: the positions (pos) at which each key's chunks of `most` bytes begin.

    Sizes (key, pos, size) are summed within ranges of positions, then over a key's ranges: no key is in one task.
    """
    at = written(sizes.repartitionByRange(key, "pos").withColumn("part", F.spark_partition_id()))
    sums = at.groupBy(key, "part").agg(F.sum("size").alias("own"))
    before = sums.select(key, "part", (F.sum("own").over(Window.partitionBy(key).orderBy("part")) - F.col("own")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy(key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    chunk = F.floor((F.col("before") + F.col("inside")) / most).alias("chunk")
    first = at.withColumn("inside", inside).join(before, [key, "part"]).groupBy(key, chunk).agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def hashed(rows: DataFrame, key: str, states: dict[str, bytes], tasks: int) -> DataFrame:
    """key, sha256 of each key's texts (pos, text, more) in order, going on from its state, if there is one; state too, where
    `more` is set. A task holds one batch of texts, not a key's. There are `tasks` of them, if the session has fewer."""
    by = [tasks, key] if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else [key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, now, digest = library(), None, None

        def out(done: list) -> pa.RecordBatch:
            names, sums = [k for k, _ in done], [d for _, d in done]
            kept = [d.state() if isinstance(d, Resumable) else None for d in sums]
            return pa.record_batch([pa.array(names, pa.string()), pa.array([d.hexdigest() for d in sums], pa.string()), pa.array(kept, pa.binary())], [key, "sha256", "state"])

        for batch in batches:
            done = []
            for k, more, text in zip(*(batch.column(c).to_pylist() for c in (key, "more", "text"))):
                if digest is None or k != now:
                    if digest is not None:
                        done.append((now, digest))
                    now, digest = k, Resumable(lib, states.get(k)) if more else hashlib.sha256()
                    if k in states:
                        digest.update(BETWEEN)
                else:
                    digest.update(BETWEEN)
                digest.update(text)
            yield out(done)
        if digest is not None:
            yield out([(now, digest)])

    dealt = rows.select(key, "pos", "more", "text").repartition(*by).sortWithinPartitions(key, "pos", "text")
    return dealt.mapInArrow(run, f"`{key}` string, sha256 string, state binary")


def joined_sha256(docs: DataFrame, groups: DataFrame, on: str, key: str, column: str, most: int = CHUNK) -> DataFrame:
    """key (a string), sha256 (lowercase hex) of the texts (`column`) of documents (pos) by key of `groups` (on, key), in the
    order of pos and with a blank line between; keys without texts are left out.

    A text of `most` bytes or less by key is hashed by one task as it passes. Longer ones are cut into chunks of about that,
    and a round hashes the next chunk of each: the state of the hash, 112 bytes a long key, goes from round to round
    through the driver, texts don't. The rounds are as many as the longest key has chunks.
    """
    texts = docs.where(F.col(column).isNotNull()).select(on, "pos", F.col(column).cast("binary").alias("text"))
    sizes = texts.select(on, "pos", (F.octet_length("text") + len(BETWEEN)).alias("size")).join(groups, on)
    totals = written(sizes.groupBy(key).agg(F.sum("size").alias("all")))
    size, largest = totals.agg(F.sum("all"), F.max("all")).first()
    rows, tasks = texts.join(groups, on), (size or 0) // most + 1
    if (largest or 0) <= most or not library():  # without it each key by one task
        return hashed(rows.withColumn("more", F.lit(False)), key, {}, tasks).select(key, "sha256")

    starts = written(chunk_starts(sizes.join(F.broadcast(totals.where(F.col("all") > most).select(key)), key), key, most))
    rounds = starts.agg(F.max(F.size("starts"))).first()[0]
    chunk = F.coalesce(F.size(F.filter("starts", lambda s: s <= F.col("pos"))) - 1, F.lit(0))
    parts = rows.join(F.broadcast(starts), key, "left").select(key, "pos", "text", F.col("starts").isNotNull().alias("more"), F.when(F.col("starts").isNull(), 0).otherwise(chunk).alias("chunk"))
    parts = written(parts, "chunk")
    first = written(hashed(parts.where("chunk = 0"), key, {}, tasks))
    last = {r[key]: (r["sha256"], r["state"]) for r in first.where("state IS NOT NULL").collect()}
    for n in range(1, rounds):
        for r in hashed(parts.where(F.col("chunk") == n), key, {k: state for k, (_, state) in last.items()}, len(last)).collect():
            last[r[key]] = r["sha256"], r["state"]
    long = docs.sparkSession.createDataFrame([(k, sha) for k, (sha, _) in last.items()], f"`{key}` string, sha256 string")
    return first.where("state IS NULL").select(key, "sha256").unionByName(long)
