"""Quality rules with an n-gram perplexity band for each language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, joined, mix, pick, stage, table, texts, word_hashes

ORDER = 4
#: Symbols that are no character: begin and end of a text.
BEGIN, END = 1, 2
#: Distinct n-grams that a task gathers before it hands them on.
GATHERED = 2 << 20
#: Entries of the model that a task holds at once. A larger model is split by hash, and texts are scored part by part.
MODEL_PART = 4 << 20
#: A document is rejected beyond so many interquartile ranges outside the quartiles of its language.
SPREAD = 3.0

#: Languages of which numbers are broadcast, some 100 bytes each.
LANGUAGES_HELD = 10_000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def per_text(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def base_counts(values: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, starts = joined(x.encode() for x in values)
    hashes, text, first, last = word_hashes(data, starts)
    n_words = np.bincount(text, minlength=len(values))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= 8:
        window = hashes[: len(hashes) - 7]
        for k in range(1, 8):
            window = mix(window, hashes[k : len(hashes) - 7 + k])
        at = np.flatnonzero(text[:-7] == text[7:])
        key = mix(window[at], text[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + 8, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    dup_lines = []
    for x in values:
        lines = [y for y in x.split("\n") if y.strip(" \t\n\v\f\r")] if "\n" in x else ()
        dup_lines.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": per_text(~blank & ((data & 0xC0) != 0x80), starts),
        "n_symbols": per_text(SYMBOL[data], starts),
        "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": np.bincount(text[covered], minlength=len(values)),
    }


def symbols(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of 16-bit symbols, each after three BEGIN and before one END; and where each begins."""
    points, at = joined(x.encode("utf-32-le", "surrogatepass") for x in values)
    at = at // 4
    code = points.view("<u4").astype(np.uint64)
    code = (code + np.uint64(3)) ^ ((code >> np.uint64(16)) * np.uint64(0x9E37))
    starts = at + np.arange(len(at)) * ORDER
    out = np.full(starts[-1], BEGIN, np.uint64)
    place = np.arange(len(code)) + np.repeat(starts[:-1] - at[:-1] + ORDER - 1, np.diff(at))
    out[place] = np.maximum(code & np.uint64(0xFFFF), np.uint64(3))
    out[starts[1:] - 1] = END
    return out, starts


def grams(stream: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place: 16 bits a symbol, the last one lowest. The first places count as BEGIN."""
    out = stream.copy()
    for k in range(1, order):
        out[k:] |= stream[:-k] << np.uint64(16 * k)
        out[:k] |= np.uint64(BEGIN << (16 * k))
    return out


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each n-gram of the highest order stands in the texts of each language. Tasks add up what
    they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = summed(parts)
                for i in range(0, len(keys), 100_000):
                    part = keys[i : i + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(counts[i : i + 100_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in chunks(batches, "text", 1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), object)
            values = np.array(texts(batch), object)
            for lang in set(langs):
                stream, starts = symbols(list(values[langs == lang]))
                real = np.ones(len(stream), bool)
                for k in range(ORDER - 1):
                    real[starts[:-1] + k] = False
                keys, counts = np.unique(grams(stream, ORDER)[real], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((keys, counts))
                if len(parts) > 8:
                    parts[:] = [summed(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > GATHERED:
                yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(n: Column) -> Column:
    """The modified Kneser-Ney discount of a count, from the numbers of n-grams seen once to four times (t1 to t4)."""
    share = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    out = F.when(n == 0, F.lit(0.0))
    for k in (1, 2, 3):
        d = k - (k + 1) * share * F.col(f"t{k + 1}") / F.col(f"t{k}")
        safe = F.when((F.col(f"t{k}") > 0) & (d > 0) & (d < k), d).otherwise(F.lit(k / 2))
        out = out.when(n == k, safe) if k < 3 else out.otherwise(safe)
    return out


def by_lang(rows: DataFrame) -> DataFrame:
    """A table with a row for each language, staged, to be joined by it: broadcast, if it isn't larger than LANGUAGES_HELD."""
    rows = stage(rows)
    return F.broadcast(rows) if rows.count() <= LANGUAGES_HELD else rows


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, gram, value: the model as numbers that add up.

    The logarithm of a text's probability is the sum of the values of all its n-grams of every order; those not listed
    count 0. For an n-gram that was seen, the value has what its probability is above that of backing off; as the context
    of the next symbol, it has the logarithm of its back-off weight. Lower orders count distinct left neighbours.
    """
    level = counts.select("lang", "gram", "n")
    levels = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (16 * order)) - 1)
        level = level.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("n"))
        levels[order] = level
    values, lower = [], None
    for order in range(1, ORDER + 1):
        seen = levels[order]
        times = seen.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)], F.count("*").alias("kinds"))
        seen = seen.join(by_lang(times), "lang").withColumn("off", discount(F.col("n")))
        seen = seen.withColumn("context", F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long"))
        before = seen.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        seen = seen.join(before, ["lang", "context"]).withColumn("weight", F.col("left") / F.col("total"))
        if order == 1:
            seen = seen.withColumn("under", 1 / (F.col("kinds") + 1.0))
        else:
            mask = F.lit((1 << (16 * (order - 1))) - 1)
            seen = seen.withColumn("suffix", F.col("gram").bitwiseAND(mask)).join(lower, ["lang", "suffix"])
        seen = seen.withColumn("p", (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("under"))
        seen = stage(seen.select("lang", "gram", "context", "weight", "under", "p"))
        lower = seen.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("under"))
        if order == 1:
            values.append(seen.select("lang", "gram", F.log("p").alias("value")))
        else:
            values.append(seen.select("lang", "gram", (F.log("p") - F.log("under") - F.log("weight")).alias("value")))
            values.append(seen.select("lang", F.col("context").alias("gram"), F.log("weight").alias("value")).dropDuplicates(["lang", "gram"]))
    out = values[0]
    for x in values[1:]:
        out = out.union(x)
    return out.groupBy("lang", "gram").agg(F.sum("value").alias("value"))


def sorted_arrays(part: DataFrame) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """lang to the sorted hashes and the values of each order."""
    got = part.select("lang", "gram", F.col("value").cast("float")).toArrow()
    keys, values, langs = got["gram"].to_numpy().view(np.uint64), got["value"].to_numpy(), got["lang"].combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy()
    out = {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        orders = []
        for order in range(1, ORDER + 1):
            here = (code == i) & (keys >> np.uint64(16 * (order - 1)) > 0) & ((keys >> np.uint64(16 * (order - 1))) < (1 << 16))
            at = np.flatnonzero(here)
            at = at[np.argsort(keys[at])]
            orders.append((keys[at], values[at].astype(np.float64)))
        out[lang] = orders
    return out


def log_probability(values: list[str], orders: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What a part of the model adds to the logarithm of each text's probability."""
    stream, starts = symbols(values)
    total = np.zeros(len(stream))
    gram = stream.copy()
    for order, (keys, worth) in enumerate(orders, 1):
        if order > 1:
            gram[order - 1 :] |= stream[: 1 - order] << np.uint64(16 * (order - 1))
            gram[: order - 1] |= np.uint64(BEGIN << (16 * (order - 1)))
        if not len(keys):
            continue
        if order == 1:
            dense = np.zeros(1 << 16)
            dense[keys.astype(np.int64)] = worth
            total += dense[stream.astype(np.int64)]
        else:
            at = np.searchsorted(keys, gram)
            at[at == len(keys)] = 0
            total += np.where(keys[at] == gram, worth[at], 0)
    for k in range(ORDER - 2):  # of the three BEGIN, the last is the context of the first symbol
        total[starts[:-1] + k] = 0
    return np.add.reduceat(total, starts[:-1])


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, log_p double"


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The base counts, n_chars and log_p (of the whole text) of every document (doc_id, text, lang).

    Of a model of several parts, each is held by itself: the texts with what the parts so far add to log_p are written
    before the next one is broadcast, and a part goes when its texts are scored.
    """
    spark = docs.sparkSession
    n_parts = math.ceil(model.count() / MODEL_PART) or 1
    out = docs.select("doc_id", "text", "lang").withColumn("log_p", F.lit(0.0))
    for k in range(n_parts):
        last = k == n_parts - 1
        held = spark.sparkContext.broadcast(sorted_arrays(model.where(F.pmod(F.xxhash64("gram"), F.lit(n_parts)) == k)))

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            arrays = held.value
            for batch in chunks(batches, "text", 1 << 20):
                values, langs = texts(batch), np.array(batch.column("lang").to_pylist(), object)
                log_p = batch.column("log_p").to_numpy().copy()
                for lang in set(langs) & arrays.keys():
                    at = np.flatnonzero(langs == lang)
                    log_p[at] += log_probability([values[i] for i in at], arrays[lang])
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(log_p)], ["doc_id", "text", "lang", "log_p"])
                    continue
                counts = base_counts(values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("lang"), *[pa.array(x.astype(np.int64)) for x in counts.values()], pa.array([len(x) for x in values], pa.int64()), pa.array(log_p)],
                    ["doc_id", "lang", *counts, "n_chars", "log_p"],
                )

        out = stage(out.mapInArrow(run, SCORED if last else "doc_id long, text string, lang string, log_p double"))
        held.destroy()
    return out


def judge(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, perplexity (by character), low, high, kept of every document.

    A character n-gram model of order 4 with modified Kneser-Ney smoothing is counted over all texts of each language. The
    logarithm of the perplexity of those that pass the base rules gives each language its quartiles; a document is kept
    within `spread` interquartile ranges outside them.

    Cases: a null text is empty; with no words it fails the base rules. A null lang and an empty one are one language, given back
    as the empty string. A language of
    which no document passes the base rules has no band, and none of it is kept. Texts are scored whole; repeated rows are
    all counted and returned; other columns are ignored; an empty table gives an empty result.
    """
    docs = pick(docs, "doc_id", "text", "lang").withColumn("lang", F.coalesce("lang", F.lit("")))
    scored = score(docs, stage(kneser_ney(stage(count_grams(docs)))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("entropy", -F.col("log_p") / (F.col("n_chars") + 1))
    quartiles = scored.where("NOT base_failed").groupBy("lang").agg(F.percentile_approx("entropy", [0.25, 0.75], 10_000).alias("q"))
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01)) * spread
    bands = quartiles.select("lang", (F.col("q")[0] - width).alias("low"), (F.col("q")[1] + width).alias("high"))
    inside = F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(False))
    return scored.join(by_lang(bands), "lang", "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("entropy").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), (~F.col("base_failed") & inside).alias("kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")
