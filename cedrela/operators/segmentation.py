"""Glued words of recognised text, split by a vocabulary that is counted over the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_punctuation, fold_only, held
from .persons import written

#: Letters of a part; letters of a word that may be glued; documents that must have a part as a word.
SHORTEST, LONGEST, GLUED, MIN_DOCS = 3, 9, 7, 3
#: Costs are in thousandths of a natural logarithm, as integers, so that sums are exact.
SCALE = 1000
EDGE = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"


def words_of(docs: DataFrame) -> DataFrame:
    """word, n, docs: folded words (a-z only) of texts (column text), how often and in how many rows they stand. A text's
    words count before they are shuffled: sorted, the first of equals counts for the text."""
    sorted_words = F.array_sort(F.split(fold_only(F.col("text")), r"[^a-z]+"))
    each = held(docs.select("text"), words=sorted_words).select(F.posexplode("words").alias("at", "word"), "words").where("word != ''")
    first = (F.col("at") == 0) | (F.get("words", F.col("at") - 1) != F.col("word"))
    return each.select("word", first.cast("long").alias("first")).groupBy("word").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def costs(counts: DataFrame) -> DataFrame:
    """word, n, docs, cost: -log of a word's share of all words; the rarer the dearer."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.withColumn("cost", F.round(SCALE * (F.ln(F.lit(total)) - F.ln("n"))).cast("long"))


def best_split(size: int, pieces: Sequence[tuple[int, int, int]]) -> tuple[int, list[int]] | None:
    """(cost, cuts) of the cheapest way through a word of `size` letters by pieces (begin, end, cost); None if there is none.

    Viterbi over the places, each worked on once for each piece that ends there; ties: fewer parts, then earlier cuts.
    """
    best: dict[int, tuple[int, int, list[int]]] = {0: (0, 0, [])}
    for begin, end, cost in sorted(pieces, key=lambda p: (p[1], p[0])):
        if begin in best:
            so_far = best[begin]
            way = so_far[0] + cost, so_far[1] + 1, [*so_far[2], end]
            if end not in best or way < best[end]:
                best[end] = way
    return (best[size][0], best[size][2][:-1]) if size in best else None


def splits(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """word, parts, cost, own: the words of GLUED letters or more that cost less as a sequence of vocabulary words (SHORTEST
    to LONGEST letters, in min_docs documents or more) than as a word of their own.

    Only distinct words are worked on: their pieces meet the vocabulary in a join, whatever its size, and each word's
    few pieces that are words go through best_split(). A piece that begins or ends nearer to an end of the word than the
    shortest part is in no way through it, nor is one as dear as the word: both are left out.
    """
    priced = costs(written(counts))
    known = priced.where(F.length("word").between(SHORTEST, LONGEST) & (F.col("docs") >= min_docs)).select(F.col("word").alias("piece"), F.col("cost").alias("price"))
    glued = priced.where(F.length("word") >= GLUED).select("word", "cost")
    begins = glued.select("word", "cost", F.explode(F.sequence(F.lit(0), F.length("word") - SHORTEST)).alias("begin")).where((F.col("begin") == 0) | (F.col("begin") >= SHORTEST))
    ends = begins.select("*", F.explode(F.sequence(F.col("begin") + SHORTEST, F.least(F.col("begin") + LONGEST, F.length("word")))).alias("end"))
    inner = ends.where((F.col("end") - F.col("begin") < F.length("word")) & ((F.col("end") == F.length("word")) | (F.col("end") <= F.length("word") - SHORTEST)))
    cut = inner.join(known, F.expr("substring(word, begin + 1, end - begin)") == F.col("piece")).where("price < cost")
    each = cut.groupBy("word", "cost").agg(F.collect_list(F.struct("begin", "end", "price")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, own, pieces in zip(*[c.to_pylist() for c in batch.columns]):
                found = best_split(len(word), [(p["begin"], p["end"], p["price"]) for p in pieces])
                if found and found[0] < own:
                    marks = [0, *found[1], len(word)]
                    rows.append((word, [word[a:b] for a, b in zip(marks, marks[1:])], found[0], own))
            words, parts, cost, own = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array(cost, pa.int64()), pa.array(own, pa.int64())], ["word", "parts", "cost", "own"])

    return each.mapInArrow(run, "word string, parts array<string>, cost long, own long")


def _cut(word: Column, parts: Column) -> Column:
    """The word as it is written, with a blank at each cut."""
    ends = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)))
    return F.array_join(F.transform(parts, lambda p, i: word.substr(F.element_at(ends, i + 1) - F.length(p) + 1, F.length(p))), " ")


def cleaned(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, separations of documents (doc_id, text): the words of `found` (word, parts) split, then punctuation
    cleaned. Rows are independent; a null text stays null. Texts meet the splits by word, and only words that are split come
    back to their text."""
    row = ["doc_id", "key"]  # rows equal in both are cleaned alike
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    words = rows.select(*row, F.posexplode(F.split("text", EDGE)).alias("at", "piece")).where(F.length("piece") >= GLUED)
    met = words.withColumn("word", fold_only(F.col("piece"))).join(written(found.select("word", "parts")), "word")
    changed = met.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "key", "at", _cut(F.col("piece"), F.col("parts")).alias("as"))
    changed = changed.groupBy(*row).agg(F.map_from_entries(F.collect_set(F.struct("at", "as"))).alias("new")).withColumnRenamed("doc_id", "_id")
    out = rows.join(changed, (F.coalesce("doc_id", F.lit(-1)) == F.col("_id")) & (rows["key"] == changed["key"]), "left")
    text = F.array_join(F.transform(F.split("text", EDGE), lambda x, i: F.coalesce(F.try_element_at("new", i), x)), "")
    return out.select("doc_id", clean_punctuation(F.when(F.col("new").isNull(), F.col("text")).otherwise(text)).alias("text"), F.coalesce(F.size("new"), F.lit(0)).alias("separations"))
