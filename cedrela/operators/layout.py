"""Words with boxes to rows, columns and lines in reading order. Geometry is a fold over a page; tasks go through many sorted pages
at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, pairwise
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import whole_pages

# Thresholds of the geometry.
OVERLAP, BAND = 0.4, 2.0
BINS, GAP, SIDE, LEAST_ROWS, ROW_SHARE, LEAST_WORDS, TOP = 240, 0.03, 0.15, 4, 0.2, 14, 0.28
WIDE_GAP, NARROW_GAP = 1.6, 0.16

WORD = "doc_id string, page int, seq int, text string, x double, y double, width double, height double, font_size double, is_bold boolean, confidence double"


def clean_words(words: DataFrame) -> DataFrame:
    """Words without blank ones, sizes of 1 at least, confidence from 0 to 1, `uncertain` under 0.6."""
    size = lambda c: F.greatest(F.coalesce(c, F.lit(1.0)), F.lit(1.0)).alias(c)
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    kept = words.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.select("doc_id", "page", "seq", F.trim("text").alias("text"), "x", "y", size("width"), size("height"), "font_size", "is_bold", sure.alias("confidence"), (sure < 0.6).alias("uncertain"))


def by_page(words: DataFrame, column: str, used: Sequence[str], each: Callable[..., list[int]]) -> DataFrame:
    """words with an integer column: what `each` gives for the values of the columns `used` of a page, in the order of y, x, seq.

    Pages come sorted and are cut out of whole batches, so a page costs no more than its words do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_pages(batches):
            keys = list(zip(rows.column("doc_id").to_pylist(), rows.column("page").to_pylist()))
            values = [rows.column(c).to_pylist() for c in used]
            cuts = [0, *(i for i, (a, b) in enumerate(pairwise(keys), 1) if a != b), len(keys)]
            out = [x for a, b in pairwise(cuts) for x in each(*(v[a:b] for v in values))]
            yield from rows.append_column(column, pa.array(out, pa.int32())).combine_chunks().to_batches()

    order = [F.asc_nulls_last(c) for c in ("y", "x", "seq")]
    return words.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", *order).mapInArrow(run, T.StructType([*words.schema.fields, T.StructField(column, T.IntegerType())]))


def cluster_rows(ys: list[float], heights: list[float]) -> list[int]:
    """The rows of a page's words, which come by y, x and seq: from top to bottom, a word joins the row that it overlaps by more
    than OVERLAP of the smaller height; a row's band grows to BAND typical heights at most."""
    typical = median(heights)
    bands: dict[int, tuple[float, float]] = {}  # those that end below the word: no other can be joined any more
    row, n = [], 0
    for y, h in zip(ys, heights):
        bands = {i: (a, b) for i, (a, b) in bands.items() if b > y}
        fits = [(min(b, y + h) - max(a, y), i) for i, (a, b) in bands.items() if min(b, y + h) - max(a, y) > OVERLAP * min(h, b - a)]
        if fits:
            i = max(fits, key=lambda f: (f[0], -f[1]))[1]
            a, b = min(bands[i][0], y), max(bands[i][1], y + h)
            if b - a <= BAND * typical:
                bands[i] = a, b
        else:
            i, n = n, n + 1
            bands[i] = y, y + h
        row.append(i)
    return row


def rows_of(words: DataFrame) -> DataFrame:
    return by_page(words, "row", ["y", "height"], cluster_rows)


def gutter(xs: list[float], ys: list[float], widths: list[float], rows: list[int], width: float) -> float | None:
    """The middle of the widest vertical gap that parts a page into two columns with enough words and rows each; without the
    top of the page if a title spans it; else null."""
    for skip in (0.0, TOP):
        top = min(ys) + skip * (max(ys) - min(ys)) if ys else 0
        part = [(x, w, r) for x, y, w, r in zip(xs, ys, widths, rows) if y >= top]
        if len(part) < LEAST_WORDS:
            return None
        change = [0] * (BINS + 1)
        for x, w, _ in part:
            first, last = max(0, int(x / width * BINS)), min(BINS - 1, int((x + w) / width * BINS))
            if first <= last:
                change[first] += 1
                change[last + 1] -= 1
        best, begin = None, None
        for k, n in enumerate([*accumulate(change[:BINS]), 1]):
            if n == 0:
                begin = k if begin is None else begin
            elif begin is not None:
                if k - begin >= GAP * BINS and (best is None or k - begin > best[0]):
                    middle = (begin + k) / 2 / BINS * width
                    left, right = [r for x, w, r in part if x + w / 2 < middle], [r for x, w, r in part if not x + w / 2 < middle]
                    share, sides = len(left) / len(part), min(len(set(left)), len(set(right)))
                    if SIDE <= share <= 1 - SIDE and sides >= max(LEAST_ROWS, ROW_SHARE * len({*left, *right})):
                        best = k - begin, middle
                begin = None
        if best:
            return best[1]
    return None


def columns_of(rows: DataFrame, page_width: float) -> DataFrame:
    """Words with `col`: 0 left or the only one, 1 right, -1 across the gutter."""

    def each(xs: list[float], ys: list[float], widths: list[float], rows: list[int]) -> list[int]:
        middle = gutter(xs, ys, widths, rows, page_width)
        if middle is None:
            return [0] * len(xs)
        return [-1 if x < middle < x + w else int(x + w / 2 >= middle) for x, w in zip(xs, widths)]

    return by_page(rows, "col", ["x", "y", "width", "row"], each)


def lines_of(words: DataFrame) -> DataFrame:
    """One line for each row and column: text joined by the gaps between words, box, fonts, bold, upper and least confidence."""
    w = Window.partitionBy("doc_id", "page", "row", "col").orderBy("x", "seq")
    em = F.coalesce("font_size", "height")
    gap = (F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)) / em
    glue = F.when(gap.isNull(), "").when(gap > WIDE_GAP, "   ").when(gap > NARROW_GAP, " ").otherwise("")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "glued"))), lambda s: s["glued"])
    letters = F.regexp_replace("text", "[^A-Za-zÁÉÍÓÚÑáéíóúñ]", "")
    out = words.withColumn("glued", F.concat(glue, "text")).groupBy("doc_id", "page", "row", "col").agg(
        F.array_join(parts, "").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x2"), F.max(F.col("y") + F.col("height")).alias("y2"),
        F.percentile("font_size", 0.5).alias("font_size"), (F.sum(F.when(F.col("is_bold"), F.length("text")).otherwise(0)) > 0.6 * F.sum(F.length("text"))).alias("is_bold"),
        ((F.sum(F.length(letters)) >= 3) & (F.min((F.upper(letters) == letters).cast("int")) == 1)).alias("is_upper"), F.min("confidence").alias("confidence"),
    )
    return out


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with band and pos: lines across both columns cut a page into bands; in a band the left column comes first."""
    by_y = Window.partitionBy("doc_id", "page").orderBy("y", "x").rowsBetween(Window.unboundedPreceding, 0)
    across = (F.col("col") == -1).cast("int")
    band = 2 * F.sum(across).over(by_y) - across  # odd: the line itself
    order = Window.partitionBy("doc_id").orderBy("page", "band", "col", "y", "x")
    return lines.withColumn("band", band).withColumn("pos", F.row_number().over(order) - 1)


def counterpart(lines: DataFrame, is_label: Column) -> DataFrame:
    """doc_id, label_pos, value_pos: for each label the line of the other column on its page with the most vertical overlap
    (2 units at least); an interval join within the page, and the best by a ranking."""
    a = lines.where(is_label).select("doc_id", "page", F.col("col").alias("c"), F.col("pos").alias("label_pos"), F.col("y").alias("a1"), F.col("y2").alias("a2"))
    b = lines.select("doc_id", "page", "col", F.col("pos").alias("value_pos"), F.col("y").alias("b1"), F.col("y2").alias("b2"))
    shared = F.least("a2", "b2") - F.greatest("a1", "b1")
    both = a.join(b, ["doc_id", "page"]).where((F.col("c") != F.col("col")) & (F.col("b1") <= F.col("a2")) & (F.col("b2") >= F.col("a1"))).withColumn("shared", shared).where("shared >= 2")
    best = F.row_number().over(Window.partitionBy("doc_id", "label_pos").orderBy(F.desc("shared"), "value_pos"))
    return both.withColumn("nth", best).where("nth = 1").select("doc_id", "label_pos", "value_pos")


def document_layouts(lines: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_pages, columns (of each page, in order), text, font_size (median of the lines), confidence (mean of the
    words; one that isn't stated is 1) of each document: lines as reading_order() gives them, words with page and confidence.

    All but the text is aggregated before the shuffle; a document's lines are gathered as its text.
    """
    pages = lines.groupBy("doc_id", "page").agg(F.when(F.max("col") > 0, 2).otherwise(1).alias("columns"))
    pages = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.transform(F.array_sort(F.collect_list(F.struct("page", "columns"))), lambda x: x["columns"]).alias("columns"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    out = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), joined.alias("text"), F.percentile("font_size", 0.5).alias("font_size"))
    sure = words.groupBy("doc_id").agg(F.avg(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    return out.join(pages, "doc_id").join(sure, "doc_id", "left").fillna(1.0, ["confidence"])
