"""How many documents each document links with: a blocked product of the incidence of classes and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Classes and shingles of a block, columns of the product that are held at once, and blocks' rows of a partition.
ROWS, SHINGLES, COLUMNS, PART = 512, 1 << 20, 4096, 4000
#: Sizes of sets that may link differ by a factor of 4/3 at most, so by one band.
BAND = 4 / 3


def blocks_of(classes: DataFrame) -> DataFrame:
    """classes (component, class, n, copies) with band and slot: the block of a class within its component. Blocks of a band
    hold ROWS classes and SHINGLES shingles on average; a class is dealt to one by its hash."""
    banded = classes.withColumn("band", F.floor(F.log("n") / float(np.log(BAND))).cast("int"))
    sizes = banded.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / SHINGLES)).alias("slots"))
    return banded.join(sizes, ["component", "band"]).withColumn("slot", F.pmod(F.xxhash64("class"), F.col("slots"))).drop("slots")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """component and two blocks of it (band_a, slot_a, band_b, slot_b), each pair once, of the same or neighbouring bands."""
    each = blocks.select("component", "band", "slot").distinct()
    a, b = each.toDF("component", "band_a", "slot_a"), each.toDF("component", "band_b", "slot_b")
    later = ((F.col("band_b") == F.col("band_a")) & (F.col("slot_a") <= F.col("slot_b"))) | (F.col("band_b") == F.col("band_a") + 1)
    return a.join(b, "component").where(later)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of a with each of b: the product of their incidence matrices, added up over
    COLUMNS shingles at a time. Shingles that only one side has take no part."""
    out = np.zeros((len(a), len(b)), np.float32)
    values = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b)]
    shared = np.intersect1d(*values)
    cells = []
    for sets, flat in zip((a, b), values):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        keep = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[keep], kind="stable")
        cells.append((row[keep][order], at[keep][order]))
    for begin in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - begin)
        parts = []
        for sets, (row, at) in zip((a, b), cells):
            low, high = np.searchsorted(at, [begin, begin + width])
            part = np.zeros((len(sets), width), np.float32)
            part[row[low:high], at[low:high] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def counted(a: list[tuple], b: list[tuple] | None) -> Iterator[tuple[int, int]]:
    """(class, documents it links with) of the classes (class, copies, set) of two blocks, or of one with itself (b None)."""
    other = a if b is None else b
    size_a, size_b = (np.array([len(s) for _, _, s in x], np.int64) for x in (a, other))
    common = overlaps([s for _, _, s in a], [s for _, _, s in other])
    link = 100 * common >= 75 * (size_a[:, None] + size_b - common)
    if b is None:
        np.fill_diagonal(link, False)
    for rows, side, copies in ((a, link, [c for _, c, _ in other]), *(((b, link.T, [c for _, c, _ in a]),) if b is not None else ())):
        yield from zip([c for c, _, _ in rows], (side @ np.array(copies, np.int64)).tolist())


def link_counts(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """class, n_links: of classes (component, class, n, copies) with their sets (class, set), how many documents of other
    classes each one's documents link with.

    Links stay within a component. A component is cut into blocks of bounded size, by size of set first, and each pair of
    blocks whose sizes may link is one product, in some task; no pair of classes is ever a row. A class is sent once for each
    block that its own meets, and gets a count from each.
    """
    blocks = stage(blocks_of(classes))
    pairs = block_pairs(blocks)
    held = blocks.join(sets.dropDuplicates(["class"]), "class")  # a set is there once for each row of a repeated doc_id
    key = ["component", "band_a", "slot_a", "band_b", "slot_b"]
    same = (F.col("band_a") == F.col("band_b")) & (F.col("slot_a") == F.col("slot_b"))
    left = pairs.withColumnsRenamed({"band_a": "band", "slot_a": "slot"}).join(held, ["component", "band", "slot"]).withColumnsRenamed({"band": "band_a", "slot": "slot_a"}).withColumn("side", F.lit(0))
    right = pairs.where(~same).withColumnsRenamed({"band_b": "band", "slot_b": "slot"}).join(held, ["component", "band", "slot"]).withColumnsRenamed({"band": "band_b", "slot": "slot_b"}).withColumn("side", F.lit(1))
    sent = left.select(*key, "side", "class", "copies", "set").unionByName(right.select(*key, "side", "class", "copies", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            found = list(counted(sides[0], sides[1] if now[1:3] != now[3:5] else None))
            return pa.record_batch([pa.array([c for c, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["class", "n_links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "side", "class", "copies")]
            for i, row in enumerate(zip(*columns)):
                if row[:5] != now:
                    if now is not None:
                        yield done()
                    now, sides = row[:5], ([], [])
                sides[row[5]].append((row[6], row[7], np.frombuffer(batch.column("set")[i].as_py(), "<u8")))
        if now is not None:
            yield done()

    n_parts = max(1, blocks.count() // PART)
    dealt = sent.repartition(max(n_parts, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key).sortWithinPartitions(*key, "side", "class")
    return dealt.mapInArrow(run, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))
