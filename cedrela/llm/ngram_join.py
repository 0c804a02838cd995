"""Near-duplicate documents by a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, chunks, components, forget, joined, mix, pick, stage, table, utf8, word_hashes
from .link_counts import link_counts

#: Words of a shingle.
WORDS = 5
#: Cells of the map that says how frequent shingles are (a power of two; 16 MB, whatever the input's size), and how many
#: frequent shingles it holds at most: with more, only the most frequent ones count as such.
CELLS, HEAVY = 1 << 24, 1 << 22
#: Shingles of so many classes are frequent.
OFTEN = 8
#: Orders in which a column's representative is chosen: so many of a group of near copies stand for it, not one.
ORDERS = 16
#: Representatives of a column in each turn; columns whose classes have become one component are done with.
REPRESENTATIVES = (4, 32)
#: Prefix entries of a block of columns, on average.
BLOCK = 500_000
#: Prefix entries that a task gathers before it hands them on, and shingles that it counts before it does.
GATHERED, COUNTED = 1 << 18, 1 << 19
#: Bytes of text of which a task holds the shingles at once.
CHUNK = 1 << 19
#: Bits of the map that says which texts are needed again (a megabyte, whatever the input's size).
WANTED = 1 << 23


def shingles(values: list[str]) -> list[np.ndarray]:
    """shingle_sets() of these texts."""
    return shingle_sets(*joined(x.encode("utf-8", "surrogatepass") for x in values))


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Each text's set of shingles, as sorted 64-bit hashes; texts as one array, and where each begins.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z in lower case. With fewer than WORDS words, the
    whole sequence is the only shingle; without words the set is empty.
    """
    hashes, text, _, _ = word_hashes(UPPER_TO_LOWER[data], starts)
    begin = np.searchsorted(text, np.arange(len(starts)))
    del text
    run = np.zeros(0, np.uint64)
    if len(hashes) >= WORDS:
        run = hashes[: len(hashes) - WORDS + 1]
        for k in range(1, WORDS):
            run = mix(run, hashes[k : len(hashes) - WORDS + 1 + k])
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(run[a : b - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            one = hashes[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one, hashes[k : k + 1])
            out.append(mix(one, np.array([b - a], np.uint64)))
        else:
            out.append(run[:0])
    return out


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set: documents with equal sets are one class."""
    spread = np.array([len(s) for s in sets], np.uint64)
    sums = np.array([np.add.reduce(mix(s, MARK)) if len(s) else 0 for s in sets], np.uint64)
    return mix(sums, spread).view(np.int64)


MARK = np.array([0x2545F4914F6CDD1D], np.uint64)


def parities(s: np.ndarray) -> bytes:
    """For each of m cells, whether it holds an odd number of the set's hashes: two bits a shingle, rounded up to a power of
    two, where the set itself takes 64."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart_at_least(x: bytes, y: bytes) -> int:
    """A number of shingles that are in only one of two sets, at least: each cell whose parities differ holds one."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, class, parity (parities()) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            sets = shingle_sets(*utf8(batch))
            cols = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(class_of(sets)), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "class", "parity"])

    return stage(docs.mapInArrow(run, "doc_id long, n long, class long, parity binary"))


class Once:
    """Lets classes through that weren't among the last ones (a table of 8 MB): most copies neither count nor go on."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << 20, np.int64)

    def __call__(self, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        for c, s in zip(class_of(sets).tolist(), sets):
            at = c & (len(self.seen) - 1)
            if len(s) and self.seen[at] != c:
                self.seen[at] = c
                yield c, s


def frequencies(docs: DataFrame) -> np.ndarray:
    """For each cell of a map, how frequent its shingles are (0: not), as a level.

    All shingles are counted: each task adds up what it gathers, then each block of shingles is added up by itself. The map
    only orders the shingles, rare ones first: any order gives the same result, a good one keeps passages that many
    documents share out of the prefixes.
    """
    n_blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, parts = Once(), []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            block = (keys % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
            keys, counts = (keys[order] >> np.uint64(32)).astype("<u4"), np.minimum(counts[order], 255).astype(np.uint8)
            some = np.flatnonzero(np.diff(cuts))
            cols = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()) for x in (keys, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *cols], ["block", "keys", "counts"])

        for batch in chunks(batches, "text", CHUNK):
            parts += [s for _, s in once(shingle_sets(*utf8(batch)))]
            if sum(map(len, parts)) > COUNTED:
                yield from flush()
        if parts:
            yield from flush()

    def added(rows: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows[c]]) for c, t in (("keys", "<u4"), ("counts", np.uint8)))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        often = total >= OFTEN
        return pa.table({"cell": pa.array((keys[first] >> np.uint32(8)).astype(np.int64)[often]), "n": pa.array(total[often])})

    found = docs.select("text").mapInArrow(run, "block long, keys binary, counts binary").groupBy("block").applyInArrow(added, "cell long, n long")
    found = stage(found.groupBy("cell").agg(F.floor(2 * F.log2(F.max("n"))).cast("int").alias("level")))
    out, held = np.zeros(CELLS, np.uint8), 0
    for level, n in sorted(found.groupBy("level").count().collect(), reverse=True):
        if held + n > HEAVY:
            break
        held += n
        out[found.where(F.col("level") == level).select("cell").toArrow()["cell"].to_numpy()] = level
    return out


def incidence(docs: DataFrame, frequent: np.ndarray, n_shingles: int) -> DataFrame:
    """shingle, class, n, pos: the part of the incidence matrix that decides which documents can meet.

    Sets of a Jaccard similarity of 0.75 or more share a shingle among the first n - ceil(0.75 n) + 1 of each, in one order
    of all shingles: rare ones first. A shingle of one class only can't make a pair and is left out: the blocks of columns
    find out about the rare ones. Entries of frequent shingles are dealt over all blocks by document and go on as they are,
    so no block grows with the number of documents that share a passage. A task gives each class once.
    """
    n_blocks = math.ceil(n_shingles * 0.26 / BLOCK) or 1
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, once = held.value, Once()
        parts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(parts)
            parts.clear()
            dealt = np.where(rows["often"], mix(rows["shingle"], rows["class"].view(np.uint64)), rows["shingle"])
            block = (dealt % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
            packed = [(b, rows[order[i:j]].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in packed], pa.int64()), pa.array([x for _, x in packed], pa.binary())], ["block", "rows"])

        for batch in chunks(batches, "text", CHUNK):
            for c, s in once(shingle_sets(*utf8(batch))):
                n = len(s)
                length = n - -(-3 * n // 4) + 1
                level = often[(s >> np.uint64(40)).astype(np.int64) & (CELLS - 1)]
                order = np.argsort(level, kind="stable")[:length]
                rows = np.zeros(length, ENTRY)
                rows["shingle"], rows["class"], rows["n"], rows["pos"], rows["often"] = s[order], c, n, np.arange(length), level[order] > 0
                parts.append(rows)
            if sum(map(len, parts)) > GATHERED:
                yield from flush()
        if parts:
            yield from flush()

    def met(group: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in group["rows"]])
        rows = rows[np.lexsort((rows["class"], rows["shingle"]))]
        if len(rows):
            new = np.append(True, (rows["shingle"][1:] != rows["shingle"][:-1]) | (rows["class"][1:] != rows["class"][:-1]))
            rows = rows[new]
            same = rows["shingle"][1:] == rows["shingle"][:-1]
            rows = rows[rows["often"] | np.append(False, same) | np.append(same, False)]
        return pa.Table.from_batches([plain(rows)])

    def plain(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c]).view(np.int64) if c == "shingle" else np.ascontiguousarray(rows[c]).astype(np.int64)) for c in COLUMNS], list(COLUMNS))

    return docs.mapInArrow(run, "block long, rows binary").groupBy("block").applyInArrow(met, "shingle long, class long, n long, pos long")


ENTRY = np.dtype([("shingle", "<u8"), ("class", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("often", "?")])
COLUMNS = ("shingle", "class", "n", "pos")


def possible(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose parities allow a Jaccard similarity of 0.75 or more.

    That similarity needs 7 times the shingles of only one set to be at most the sum of both sizes.
    """
    known = described.select("class", "n", "parity").dropDuplicates(["class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "parity_a", "parity_b"))
            keep = pa.array([7 * apart_at_least(x, y) <= n + k for n, k, x, y in zip(*cols)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.join(known.toDF("b", "n_b", "parity_b"), "b").join(known.toDF("a", "n_a", "parity_a"), "a")
    return both.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, described: DataFrame, classes: DataFrame) -> DataFrame:
    """class, set (sorted hashes) of these classes, from the text of one document of each.

    A map of WANTED bits leaves out most texts that aren't needed, and the join by doc_id the others.
    """
    one = stage(described.join(classes, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(WANTED)) + 1  # bitmap functions number their buckets, and the values in them, from 1
    parts = one.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((WANTED >> 15, 4096), np.uint8)
    for k, part in parts:
        bits[k - 1] = np.frombuffer(part, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column("place").to_numpy() - 1
            keep = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
            for part in chunks([batch.filter(pa.array(keep.astype(bool)))], "text", CHUNK):
                sets = shingle_sets(*utf8(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(class_of(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "class", "set"])

    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text", place.alias("place")).mapInArrow(run, "doc_id long, class long, set binary")
    return some.join(one, "doc_id", "left_semi").select("class", "set")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.75 or more.

    The sets of all pairs of a batch with the same a are the rows of one block; its product with a's row counts the overlaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), bool)
            row, past, lengths = None, None, None
            begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
            for i, j in zip(begin, [*begin[1:], len(a)]):
                row = np.frombuffer(batch.column("set_a")[int(i)].as_buffer(), "<u8")
                others = [np.frombuffer(batch.column("set_b")[int(k)].as_buffer(), "<u8") for k in range(i, j)]
                lengths = np.array([len(x) for x in others])
                block = np.concatenate(others)
                at = np.searchsorted(row, block)
                at[at == len(row)] = 0
                past = np.concatenate([[0], np.cumsum(row[at] == block)])
                ends = np.cumsum(lengths)
                overlap = past[ends] - past[ends - lengths]
                keep[i:j] = 100 * overlap >= 75 * (len(row) + lengths - overlap)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    left, right = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link: parities first, then the sets of those that are left."""
    left = stage(possible(pairs, described))
    sets = stage(sets_of(docs, described, left.select(F.explode(F.array("a", "b")).alias("class")).distinct()))
    return linked(left, sets)


def represented(at: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): each class of each column against the representatives of its band of sizes that are of another
    component. A representative is the first of its share of the classes. The orders in which columns choose it, and the ends of the bands, are others in each turn."""
    banded = at.withColumn("band", F.floor(F.log("n") / math.log(4 / 3) + turn / 2))
    order = F.xxhash64("class", F.pmod("shingle", F.lit(ORDERS)), F.lit(turn))
    slot = F.pmod(F.xxhash64("class", F.lit(-1 - turn)), F.lit(REPRESENTATIVES[turn]))
    first = banded.groupBy("shingle", "band", slot.alias("slot")).agg(F.min(F.struct(order.alias("order"), "n", "class", "pos", "component")).alias("f"))
    first = first.select("shingle", "band", "f.n", "f.class", "f.pos", "f.component").toDF("shingle", "band", "n_f", "a", "pos_f", "component_f")
    fits = 7 * (1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n_f") - F.col("pos_f") - 1)) >= 3 * (F.col("n") + F.col("n_f"))
    tests = banded.join(first, ["shingle", "band"]).where((F.col("component") != F.col("component_f")) & fits)
    return stage(tests.select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct())


def near_duplicates(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (and, with count_links, n_links) of every document (doc_id, text).

    Two documents link when 100 * intersection >= 75 * union of their shingle sets (shingles()); component_id is the
    smallest doc_id that links reach. Every link between different sets either is tested or joins what is already one
    component:

    1. Documents with equal sets are one class; only classes go on.
    2. incidence() leaves the prefix columns that two classes share. In each column, and band of sizes, every class is tested
       against REPRESENTATIVES, which a column chooses in one of ORDERS orders: a group of near copies costs so many tests for
       each, not one for each pair. That is done in turns, with more of them in the columns of more than one component.
    3. In columns in which more than one component is left, the classes outside the column's largest component are tested
       against those of other components.

    In both, pairs are discarded whose sizes, or what follows their first common shingle, or the parities of whose cells
    (possible()) don't allow the similarity. Only what is left is compared set by set.

    n_links is the number of other documents that a document links with: the copies of its own set, and those of every set
    that is similar enough, out of a blocked product of the classes of each component (link_counts()).

    Cases: a null text is empty; documents without words have the empty set and link with nothing. Repeated rows are all
    returned, and link if they have words. A null doc_id has a null component, and links with copies only. Texts are processed whole; other columns are
    ignored; an empty table gives an empty result.
    """
    docs = pick(docs, "doc_id", "text")
    described = describe(docs)
    frequent = frequencies(docs)
    forget(docs.sparkSession)
    total = described.agg(F.sum("n")).first()[0] or 0
    shown = stage(incidence(docs, frequent, total))
    forget(docs.sparkSession)
    overlap = lambda x, y: 7 * (1 + F.least(x["n"] - x["pos"] - 1, y["n"] - y["pos"] - 1)) >= 3 * (x["n"] + y["n"])

    at, links, tests, found = shown.withColumn("component", F.col("class")), None, None, None
    for turn in range(len(REPRESENTATIVES)):
        new = represented(at, turn)
        tests = new if tests is None else stage(tests.union(new.join(tests, ["a", "b"], "left_anti")))
        more = stage(compared(new, docs, described))
        links = more if links is None else links.union(more)
        forget(docs.sparkSession)
        # Columns of several components go on.
        found = components(links)
        at = at.drop("component").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        several = at.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("shingle")
        at = stage(at.join(several, "shingle", "left_semi"))
        forget(docs.sparkSession)

    most = at.groupBy("shingle", "component").count().groupBy("shingle").agg(F.max(F.struct("count", "component")).alias("m"))
    at = at.join(most.select("shingle", F.col("m.component").alias("major")), "shingle")
    x, y = at.where("component != major").alias("x"), at.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.class") < F.col("y.class")))
    sized = (4 * F.col("x.n") >= 3 * F.col("y.n")) & (4 * F.col("y.n") >= 3 * F.col("x.n"))
    cols = lambda s: {c: F.col(f"{s}.{c}") for c in ("n", "pos")}
    rest = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(apart & sized & overlap(cols("x"), cols("y")))
    rest = rest.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    more = stage(compared(rest.join(tests, ["a", "b"], "left_anti"), docs, described))
    forget(docs.sparkSession)
    merged = components(links.union(more))

    classes = described.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"))
    merged = merged.withColumnRenamed("node", "class").join(classes, "class")
    if count_links:
        merged = stage(merged)
        several = merged.select("component", "class", "n", "copies")
        others = stage(link_counts(several, stage(sets_of(docs, described, several.select("class")))))
        forget(docs.sparkSession)
    lowest = merged.groupBy("component").agg(F.min("least").alias("lowest"))
    named = merged.join(lowest, "component").select("class", "lowest")
    named = classes.join(named, "class", "left").select("class", "copies", F.coalesce("lowest", "least").alias("component_id"))
    if count_links:
        named = named.join(others, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n_links", F.lit(0)))
    out = described.join(named, "class", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), *more)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), count_links=True)
