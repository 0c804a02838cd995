"""Audit of how the sources of a language differ in their terms."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, joined, kept_bytes, mix, pick, runs, small_batches, stage, table, word_hashes

#: A term is kept if so many documents of its language have it.
MIN_DOCS = 30
#: What is added to each count, and the whole that shares are given of.
ADDED, WHOLE = 5, 1_000_000_000
#: Ranks of terms that are returned.
TOP = 50
#: Rows of the sketch; cells of a row at least and at most; cells for each document; cells of a chunk.
DEPTH, LEAST, MOST, PER_DOC, CHUNK = 2, 1 << 16, 1 << 28, 64, 1 << 16
#: Distinct terms of groups that a task holds before it passes them on; bytes of text in a batch.
HELD, BATCH = 700_000, 1 << 20
TERMS = kept_bytes(bytes(range(97, 123)))

Counts = dict[tuple, Counter]


def counted(batches: Iterable[pa.RecordBatch], by: list[str], occurrences: bool) -> Iterator[tuple[Counts, Counts]]:
    """Occurrences (if asked for) and documents of each term, by the columns `by`; passed on when HELD terms are there."""
    n, docs, size = defaultdict(Counter), defaultdict(Counter), 0
    for batch in chunks(batches, "text", BATCH):
        for group, text in zip(zip(*[batch.column(x).to_pylist() for x in by]), batch.column("text").to_pylist()):
            seen: set[bytes] = set()
            for words in runs(text, TERMS):
                seen.update(words)
                if occurrences:
                    n[group].update(words)
            held = docs[group]
            size -= len(held)
            held.update(seen)
            size += len(held)
            if size > HELD:
                yield n, docs
                n, docs, size = defaultdict(Counter), defaultdict(Counter), 0
    yield n, docs


def cells(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """The cells of the sketch for these terms of a language: a column for each term."""
    h = mix(word_hashes(*joined(terms))[0], np.full(len(terms), zlib.crc32(lang.encode()), np.uint64))
    low = np.uint64(width - 1)
    return np.stack([(h >> np.uint64(32 * d) & low).astype(np.int64) + d * width for d in range(DEPTH)])


def sketch(docs: DataFrame, width: int, min_docs: int) -> np.ndarray:
    """A bit for each cell of the merged count-min sketch of document frequencies: does it reach min_docs?

    Tasks give the cells that their documents touch, chunk by chunk; chunks are merged one at a time. Counts stop at
    min_docs, more doesn't matter; so nothing is ever underestimated below it. What comes to the driver are the bits: at most
    2 * MOST / 8 = 64 MB, 8 MB for a million documents.
    """
    kind = np.min_scalar_type(2 * min_docs)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, by_lang in counted(batches, ["lang"], False):
            parts = [(cells(lang, list(c), width), np.fromiter(c.values(), np.int64)) for (lang,), c in by_lang.items() if c]
            if not parts:
                continue
            at, inverse = np.unique(np.concatenate([x.ravel() for x, _ in parts]), return_inverse=True)
            n = np.minimum(np.bincount(inverse, np.concatenate([np.tile(x, DEPTH) for _, x in parts])), min_docs).astype(kind)
            chunk, place = at // CHUNK, (at % CHUNK).astype("<u2")
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(at)]
            spans = list(zip(cuts, cuts[1:]))
            yield pa.record_batch(
                [pa.array(chunk[cuts[:-1]], pa.int64()), pa.array([place[a:b].tobytes() for a, b in spans]), pa.array([n[a:b].tobytes() for a, b in spans])],
                ["chunk", "place", "n"],
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(CHUNK, kind)
        out = lambda: pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(held >= min_docs).tobytes()])], ["chunk", "bits"])
        for batch in batches:
            for chunk, place, n in zip(*[c.to_pylist() for c in batch.columns]):
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, held = chunk, np.zeros(CHUNK, kind)
                at = np.frombuffer(place, "<u2")
                held[at] = np.minimum(held[at] + np.frombuffer(n, kind), min_docs)
        if now is not None:
            yield out()

    given = docs.select("lang", "text").mapInArrow(touched, "chunk long, place binary, n binary")
    bits = np.zeros((DEPTH * width // CHUNK, CHUNK // 8), np.uint8)
    for chunk, row in given.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merged, "chunk long, bits binary").collect():
        bits[chunk] = np.frombuffer(row, np.uint8)
    return bits.ravel()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, width: int | None = None) -> DataFrame:
    """lang, source, term, n, docs: exact counts of the terms that the sketch lets through, by group.

    Every term of min_docs documents or more is there (the sketch underestimates none); some rarer ones may be.
    """
    spark = docs.sparkSession
    if width is None:
        width = min(MOST, max(LEAST, 1 << (PER_DOC * docs.count()).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(docs, width, min_docs))

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, by_group in counted(batches, ["lang", "source"], True):
            langs = defaultdict(list)
            for lang, source in by_group:
                langs[lang].append(source)
            for lang, sources in langs.items():
                terms = list({t: None for source in sources for t in by_group[lang, source]})
                if not terms:
                    continue
                at = cells(lang, terms, width)
                fine = ((bits.value[at >> 3] << (at & 7).astype(np.uint8)) & 128).all(axis=0)
                place = dict(zip(terms, range(len(terms))))
                rows = []
                for i, source in enumerate(sources):
                    c, own = by_group[lang, source], n[lang, source]
                    of = np.fromiter(map(place.__getitem__, c), np.int64, len(c))
                    each = (of, np.full(len(c), i), np.fromiter(map(own.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c)))
                    rows.append([x[fine[of]] for x in each])
                of, source, times, docs = (np.concatenate(x) for x in zip(*rows))
                order = np.argsort(of, kind="stable")
                kept, first = np.unique(of[order], return_index=True)
                ends = pa.array(np.append(first, len(of)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(sources, pa.string()).take(pa.array(source[order])), pa.array(times[order]), pa.array(docs[order]))]
                yield pa.record_batch([pa.array([lang] * len(kept), pa.string()), pa.array([terms[i] for i in kept], pa.binary()).cast(pa.string()), *lists], ["lang", "term", "source", "n", "docs"])

    found = docs.mapInArrow(survivors, "lang string, term string, source array<string>, n array<long>, docs array<long>")
    # A task gives each term once, with its sources; they meet by term, and only then are they taken apart.
    spread = F.explode(F.arrays_zip("source", "n", "docs")).alias("x")
    return found.repartition("lang", "term").select("lang", "term", spread).groupBy("lang", "term", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.sum("x.docs").alias("docs")).select("lang", "source", "term", "n", "docs")


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * kept)), exactly."""
    big = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(28,0)")
    over = big(total) + F.lit(ADDED) * big(kept)
    return F.when(over > 0, F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * (big(n) + F.lit(ADDED)), over) + 1)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank of every group of a language and a source.

    part `pair`: the sum of differences between the group's shares and those of each other source of its language. part
    `term`: the terms that the group has more of than its language has, with the difference, up to rank `top`.

    A first pass merges count-min sketches of document frequencies over all documents; the second counts, exactly, only what
    they let through, so impossible terms never reach a shuffle. Sums over pairs are sparse: a term that neither source has
    differs by the same amount for all such terms, a term of one source counts by how often it is there (one row for each
    distinct count), and only terms that both have meet in a join by term.

    Cases: null text, lang and source are empty. Rows are documents, whatever their doc_id. A group without a kept term has
    the shares of count 0; a language without one has differences of 0 and no terms. A language of one source has no pairs.
    Equal values are ranked by item in the order of UTF-8 bytes. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, "text", "lang", "source").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = stage(term_counts(docs, min_docs, width))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = stage(kept)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    own = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
    groups = (
        docs.select("lang", "source").distinct()
        .join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .na.fill(0, ["total", "kept", "all_total"])
        .withColumn("none", F.coalesce(share(F.lit(0), "total", "kept"), F.lit(0)))
    )
    groups = stage(groups)
    shares = own.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    shares = shares.select("lang", "source", "term", "n", "p", "none", share("all_n", "all_total", "kept").alias("q"))

    # With a's and b's shares of count 0 alike in all terms, the sum over terms is kept * |a0 - b0|, and what the terms of a, of b and of both add to that.
    a = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("a0"), "kept")
    b = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("b0"))
    pairs = a.join(b, "lang").where("a != b")
    levels = shares.groupBy("lang", F.col("source").alias("a"), "n").agg(F.first("p").alias("p"), F.count("*").alias("terms"))
    alone = levels.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.expr("terms * (abs(p - b0) - abs(a0 - b0))")).alias("alone"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("none").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("none").alias("b0"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b")
    both = stage(both.agg(F.sum(F.expr("abs(pa - pb) - abs(pa - b0) - abs(a0 - pb) + abs(a0 - b0)")).alias("both")))
    turn = lambda df, *names: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), *names)
    alone = stage(alone)
    added = alone.withColumnRenamed("alone", "x").unionByName(turn(alone, F.col("alone").alias("x")))
    added = added.unionByName(both.withColumnRenamed("both", "x")).unionByName(turn(both, F.col("both").alias("x"))).groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))
    apart = pairs.join(added, ["lang", "a", "b"], "left").select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.expr("kept * abs(a0 - b0) + coalesce(x, 0)").alias("value")
    )
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("p - q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda df: df.select("*", rank)
    return ranked(apart).unionByName(ranked(more).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: All terms are counted, and all pairs of sources compared term by term here.
OP11_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurrence AS (SELECT doc, lang, source, unnest(terms) AS term FROM doc
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrence GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}
), lang_size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM doc
), counted AS (SELECT lang, source, term, count(*) AS n FROM occurrence SEMI JOIN kept USING (lang, term) GROUP BY ALL
), grp_size AS (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL
), share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({WHOLE}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (coalesce(s.total, 0) + {ADDED} * l.v)::HUGEINT AS p,
    1 + ({WHOLE}::HUGEINT * (k.n + {ADDED})) // (l.total + {ADDED} * l.v)::HUGEINT AS q
  FROM grp g JOIN kept k USING (lang) JOIN lang_size l USING (lang)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN grp_size s ON s.lang = g.lang AND s.source = g.source
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN share x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN share y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), everything AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM share WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM everything
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
