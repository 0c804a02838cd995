"""Values beside, below or above their labels on a page of two columns; the top of the first page; the largest name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import fold
from . import labels

# How far a label's band reaches beyond its line, least shared height, how far below or above a value may stand.
REACH, SHARED, HEIGHTS, SLACK, TOUCH = 3.0, 2.0, 2.5, 6.0, 2.0
#: Share of the first page's height that is its top.
TOP = 0.25

LINK = "doc_id {kind}, label_pos long, value_pos long, way string"


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in the same order, in tables of some batches' size in which no page is cut."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        ends = [rows.column(c)[rows.num_rows - 1].as_py() for c in ("doc_id", "page")]
        last = np.ones(rows.num_rows, bool)
        for c, x in zip(("doc_id", "page"), ends):
            last &= np.array([v == x for v in rows.column(c).to_pylist()])
        cut = int(np.argmax(last))
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _page_numbers(rows: pa.Table) -> np.ndarray:
    """0, 1, 2 ... for the pages of sorted rows."""
    keys = list(zip(rows.column("doc_id").to_pylist(), rows.column("page").to_pylist()))
    return np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))])


def _partners(page: np.ndarray, side: np.ndarray, top: np.ndarray, bottom: np.ndarray, label: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, str]]:
    """(label, value, way) as row numbers: one sweep over many pages, each shifted below the one before it."""
    far = max(float((bottom - top).max(initial=0)), 1.0)
    step = float(bottom.max(initial=0) - top.min(initial=0)) + 4 * (far * (HEIGHTS + 1) + SLACK + REACH)
    begin, end = top + page * step, bottom + page * step
    out = []
    for here, there in ((0, 1), (1, 0)):
        others = np.flatnonzero(side == there)
        others = others[np.lexsort((pos[others], begin[others]))]
        by_begin = begin[others]
        for i in np.flatnonzero(label & (side == here)):
            low, high, height = begin[i] - REACH, end[i] + REACH, end[i] - begin[i]
            near = others[np.searchsorted(by_begin, low - far, "left") : np.searchsorted(by_begin, high, "right")]
            shared = np.minimum(high, end[near]) - np.maximum(low, begin[near])
            if len(near) and shared.max() >= SHARED:
                most = near[shared == shared.max()]
                out.append((int(i), int(most[np.argmin(pos[most])]), "row"))
                continue
            reach = height * HEIGHTS + SLACK
            at = int(np.searchsorted(by_begin, end[i] - TOUCH, "left"))
            if at < len(others) and by_begin[at] - end[i] < reach:
                out.append((int(i), int(others[at]), "below"))
                continue
            at = int(np.searchsorted(by_begin, end[i] - reach, "right"))
            near = others[at : np.searchsorted(by_begin, begin[i] + TOUCH, "right")]
            near = near[end[near] <= begin[i] + TOUCH]
            if len(near):
                highest = near[begin[near] == begin[near].max()]
                out.append((int(i), int(highest[0]), "above"))
    return out


def partners(lines: DataFrame, is_label: Column) -> DataFrame:
    """doc_id, label_pos, value_pos, way: the line of the other column (col 0 and 1) that belongs to each label.

    row: the one that shares the most height with the label's band, SHARED at least; else below: the first that begins under
    the label, within HEIGHTS of its height; else above: the last before it, as near. Ties: the smaller pos. lines: doc_id,
    page, col, pos, y, y2. Lines across both columns (col -1) take no part.

    Pages come sorted, and tasks sweep over many at a time; a page is never compared with another.
    """
    kind = dict(lines.dtypes)["doc_id"]
    sides = lines.where(F.col("col").isin(0, 1)).select("doc_id", "page", F.col("col").cast("int").alias("col"), F.col("pos").cast("long").alias("pos"), F.col("y").cast("double").alias("y"), F.col("y2").cast("double").alias("y2"), F.coalesce(is_label, F.lit(False)).alias("label"))
    sides = sides.where("doc_id IS NOT NULL AND page IS NOT NULL AND y IS NOT NULL AND y2 IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_pages(batches):
            column = lambda c: rows.column(c).to_numpy()  # noqa: B023, E731
            found = _partners(_page_numbers(rows), column("col"), column("y"), column("y2"), rows.column("label").to_numpy(), column("pos"))
            label, value, way = zip(*found) if found else ((), (), ())
            at = pa.array(label, pa.int64())
            ids, pos = rows.column("doc_id").combine_chunks(), rows.column("pos").combine_chunks()
            yield pa.record_batch([ids.take(at), pos.take(at), pos.take(pa.array(value, pa.int64())), pa.array(way, pa.string())], ["doc_id", "label_pos", "value_pos", "way"])

    return sides.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y", "pos").mapInArrow(run, LINK.format(kind=kind))


def in_scopes(lines: DataFrame, markers: tuple[str, ...] | None = None) -> DataFrame:
    """lines with `scope`: employer above the first line (in reading order) that opens the worker's part, by page and height,
    whatever their column; worker from there on; null where there is no such line, or just one line on that side."""
    head = F.trim(F.regexp_replace(fold(F.col("text")), r"[:.]\s*$", ""))
    markers = markers or labels.WORKER_MARKERS
    opens = head.isin(*markers)
    for m in markers:
        opens = opens | head.startswith(f"{m} ") | head.startswith(f"{m}: ")
    whole = Window.partitionBy("doc_id")
    cut = F.min(F.when(opens, F.struct("pos", F.struct("page", "y").alias("at")))).over(whole)["at"]
    side = F.when(F.struct("page", "y") < cut, "employer").when(F.struct("page", "y") >= cut, "worker")
    marked = lines.withColumn("side", side)
    return marked.withColumn("scope", F.when(F.count("*").over(Window.partitionBy("doc_id", "side")) >= 2, F.col("side"))).drop("side")


def label_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs as labels.candidates() has them, of lines that end in a colon or have four words at most and their partner in
    the other column; and the lines with their partner's text after their own, for dates. lines: with scope."""
    text = F.col("text")
    short = (F.size(F.split(fold(text), " ")) <= 4) & ~text.rlike("[0-9]") & ~text.rlike(r":\s*\S")
    linked = partners(lines, text.rlike(r":\s*$") | short)
    values = lines.select("doc_id", F.col("pos").alias("value_pos"), F.trim("text").alias("value"))
    met = linked.join(values, ["doc_id", "value_pos"]).where(~F.col("value").rlike(r"[:;]\s*$")).select("doc_id", F.col("label_pos").alias("pos"), "value")
    named = lines.join(met, ["doc_id", "pos"])
    label = fold(F.regexp_replace("text", r"\s*[:.]?\s*$", ""))
    pairs = named.select("doc_id", "pos", "scope", F.lit(0).alias("nth"), label.alias("label"), "value", F.lit(False).alias("alone"))
    beside = lines.join(met, ["doc_id", "pos"], "left").withColumn("text", F.concat_ws(" ", "text", "value")).drop("value")
    return pairs, beside


def header_rows(found: DataFrame, page_height: Column, least: int = 3, first: int = 12) -> DataFrame:
    """Of lines in sections with their place (page, y): those before the first heading, about contact, or in the top of the
    first page (a name may stand over the right column, after all of the left one); of documents with fewer than `least` of
    them, the `first` ones. Lines of references never count."""
    heads = F.col("section").isin("encabezado", "contacto") | ((F.col("page") == 0) & (F.col("y") < TOP * page_height))
    kept = found.where("section != 'referencias'").withColumn("_head", heads)
    marked = kept.withColumn("_n", F.sum(F.col("_head").cast("int")).over(Window.partitionBy("doc_id")))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return marked.withColumn("_nth", nth).where(F.when(F.col("_n") >= least, F.col("_head")).otherwise(F.col("_nth") <= first)).drop("_head", "_n", "_nth")


def largest_name(rows: DataFrame) -> DataFrame:
    """doc_id, name: of lines that look like a name and are no list item, the one in the largest type, then the highest, then
    on the first page."""
    named = rows.where(names.looks_like_name(F.col("text")) & ~F.col("text").rlike(r"^\s*[•*+·●▪‣>-]"))
    order = F.struct(-F.coalesce("font_size", F.lit(0.0)), "y", "page", "pos")
    return named.groupBy("doc_id").agg(F.min_by("text", order).alias("name"))
