"""Files to texts: router by extension, plain text, Word files, archives; words out of PDF items and recognition output."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

# What is read, and how far each way of reading is trusted.
IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff"]
METHOD = {"txt": "txt", "text": "txt", "docx": "docx", "pdf": "pdf_text", "zip": "zip"} | {x: "ocr" for x in IMAGES}
TRUST = {"txt": 0.99, "docx": 0.98, "pdf_text": 0.96}
MAX_BYTES = 10 << 20
PDF_TEXT_CHARS = 60


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def people_folders(files: DataFrame, root: str) -> DataFrame:
    """name, kind (carpeta or zip), files (paths, in order), nth: one row for each folder right below root that has images
    somewhere below it, and for each archive in root, named without its ending; nth is the place in Spanish order."""
    rest = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").split(":")[-1]) + "/", "")
    at = files.select("path", rest.alias("rest")).withColumn("top", F.regexp_extract("rest", "^([^/]+)/", 1))
    image = F.lower(F.regexp_extract("rest", r"\.([^./]+)$", 1)).isin(IMAGES)
    folders = at.where((F.col("top") != "") & image).groupBy(F.col("top").alias("name")).agg(F.array_sort(F.collect_list("path")).alias("files")).withColumn("kind", F.lit("carpeta"))
    zips = at.where((F.col("top") == "") & F.lower("rest").endswith(".zip")).select(F.regexp_replace("rest", r"(?i)\.zip$", "").alias("name"), F.array("path").alias("files"), F.lit("zip").alias("kind"))
    return search.in_locale_order(folders.unionByName(zips).withColumn("_all", F.lit(0)), ["_all"], "name").select("name", "kind", "files", "nth")


def routed(files: DataFrame) -> DataFrame:
    """files with extension, method (null: not supported, for a quarantine) and prior confidence."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("extension", ext).withColumn("method", _map(METHOD, F.col("extension"))).withColumn("confidence", _map(TRUST, F.col("method")))


def texts(files: DataFrame) -> DataFrame:
    """path, text of plain text files: UTF-8, without a byte order mark, trimmed."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.select("path", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_texts(files: DataFrame) -> DataFrame:
    """path, text, error of Word files: the text of each paragraph, one a line. A file that can't be read has its error."""

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return None, type(e).__name__
        return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")) for p in root.iter(f"{WORD_NS}p")), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(x) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def members(path: str, content: bytes) -> list[tuple[str, int, bytes | None]]:
    """path (`archive!member`), length, content of what can be read in an archive, in order; one row without content for a
    broken one."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return [(path, 0, None)]
    rows = []
    for name in archive.namelist():
        last = name.rsplit("/", 1)[-1]
        if last and not last.startswith(".") and "__MACOSX" not in name and last.rsplit(".", 1)[-1].lower() in METHOD:
            data = archive.read(name)
            rows.append((f"{path}!{name}", len(data), data))
    return rows


def opened(files: DataFrame, others: bool = True) -> DataFrame:
    """path, length, content of files, with archives replaced by their members (hidden files and resource forks aside).
    others: files that are no archives stay as they are; else everything is taken for an archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                plain = others and not path.lower().endswith(".zip")
                yield pd.DataFrame([(path, len(content), content)] if plain else members(path, content), columns=["path", "length", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, length long, content binary")


def unzipped(files: DataFrame) -> DataFrame:
    """path, length, content of the members of archives."""
    return opened(files, others=False)


def data_uri(files: DataFrame, mime: str) -> DataFrame:
    """path, uri of files up to MAX_BYTES."""
    return files.where(F.col("length") <= MAX_BYTES).select("path", F.concat(F.lit(f"data:{mime};base64,"), F.base64("content")).alias("uri"))


def pdf_words(items: DataFrame) -> DataFrame:
    """Words out of PDF text items (doc_id, page, seq, text, a scale, a skew, x, y from below, width, height, font, the page's
    height): y from above, ascent 0.8, bold by the font's name."""
    size = F.greatest(F.coalesce(F.nullif(F.hypot("scale", "skew"), F.lit(0.0)), F.nullif("height", F.lit(0.0)), F.lit(10.0)), F.lit(1.0))
    return items.where(F.trim("text") != "").select(
        "doc_id", "page", "seq", F.trim("text").alias("text"), "x", (F.col("page_height") - F.col("y") - 0.8 * size).alias("y"), "width", size.alias("height"), size.alias("font_size"),
        F.lower("font").rlike("bold|black|heavy").alias("is_bold"), F.lit(1.0).alias("confidence"),
    )


def needs_recognition(words: DataFrame) -> DataFrame:
    """doc_id, scanned: pages that hold fewer than PDF_TEXT_CHARS characters on average have no text layer."""
    pages = words.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"))
    return pages.groupBy("doc_id").agg((F.avg("n") < PDF_TEXT_CHARS).alias("scanned"))


def recognised_words(blocks: DataFrame) -> DataFrame:
    """doc_id, page, seq, word... out of nested recognition output (blocks of paragraphs of lines of words); missing levels
    are tolerated."""
    out = blocks
    for level in ("blocks", "paragraphs", "lines"):
        out = out.withColumn("_item", F.explode_outer(level)).drop(level).select("*", "_item.*").drop("_item")
    words = out.select("doc_id", "page", F.posexplode_outer("words").alias("seq", "w")).where("w IS NOT NULL")
    return words.select("doc_id", "page", "seq", "w.*")


def pending(inputs: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What a resumed batch has still to read."""
    return inputs.join(done.select(key), key, "left_anti")


def repaired(results: DataFrame, again: DataFrame, key: str = "path") -> DataFrame:
    """results with the rows that had an error replaced by what a second run gave for them."""
    names = [c for c in results.columns if c != key]
    second = again.select(key, *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_again"))
    both = results.join(second, key, "left")
    use = F.col("error").isNotNull() & F.coalesce("_again", F.lit(False))
    return both.select(key, *[F.when(use, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names])
