"""A quality classifier by co-training of two views."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import chunks, joined, mix, pick, small_batches, stage, table, texts, utf8, word_hashes

#: The classifier is fitted on at most so many labelled documents; it exchanges pseudo-labels over all others.
MAX_LABELLED = 8000
#: Numbers of labelled documents that are broadcast (8 bytes each); more are joined.
MAX_KNOWN = 2_000_000
#: Rounds of co-training, documents that a view hands to the other in each, and how sure it must be of them.
ROUNDS, EXCHANGED, SURE = 4, 200, 0.95
#: Documents below this probability of being good are rejected.
THRESHOLD = 0.5

BUCKETS = 256
CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "feed": b"\n", "blank": b" \t\r", "other": range(128, 256),
}


def text_view(values: list[str]) -> np.ndarray:
    """Features of the content: shares of kinds of characters, of words, of repetitions, and hashed trigrams of bytes."""
    data, starts = joined(x.encode("utf-8", "surrogatepass") for x in values)
    n, length = len(values), np.maximum(np.diff(starts), 1)
    kind = np.full(256, len(CLASSES), np.int64)
    for i, members in enumerate(CLASSES.values()):
        kind[list(members)] = i
    text = np.repeat(np.arange(n), np.diff(starts))
    shares = np.bincount(text * (len(CLASSES) + 1) + kind[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1) / length[:, None]
    hashes, of, first, last = word_hashes(data, starts)
    words = np.maximum(np.bincount(of, minlength=n), 1)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    distinct = np.bincount(of[np.unique(mix(hashes, of.astype(np.uint64)), return_index=True)[1]], minlength=n)
    odd = np.isin(data[np.maximum(last - 1, 0)], list(b"#*$%&|<>!")) if len(last) else np.zeros(0)
    more = np.stack(
        [np.log1p(length), np.log1p(words), length / words, np.bincount(of, same, n) / words, distinct / words, np.bincount(of, odd, n) / words], axis=1
    )
    small = data.astype(np.uint32)
    if len(small) > 2:
        tri = (small[:-2] * 961 + small[1:-1] * 31 + small[2:]) * np.uint32(2654435761) >> np.uint32(24)
        inside = text[:-2] == text[2:]
        tri = np.bincount((text[:-2] * BUCKETS + tri)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    else:
        tri = np.zeros((n, BUCKETS))
    return np.hstack([np.sqrt(shares), more, np.sqrt(tri / length[:, None])])


def meta_view(langs: list[str | None], sources: list[str | None], sizes: list[int | None]) -> np.ndarray:
    """Features of the metadata: hashed language and source, and the size that the page states."""
    bucket = lambda x, k: sum(c * 31**i for i, c in enumerate((x or "").encode("utf-8", "surrogatepass"))) % k
    out = np.zeros((len(langs), 16 + 64 + 3))
    rows = np.arange(len(langs))
    out[rows, [bucket(x, 16) for x in langs]] = 1
    out[rows, [16 + bucket(x, 64) for x in sources]] = 1
    out[:, -3] = [x is None for x in sizes]
    out[:, -2] = [np.log1p(max(x or 0, 0)) for x in sizes]
    out[:, -1] = out[:, -2] ** 2 / 10
    return out


#: Rows of a matrix of features that are standardised, in double precision, at once.
ROWS = 1024


def blocks(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(x), ROWS):
        yield slice(at, at + ROWS), x[at : at + ROWS].astype(float)


@dataclass
class View:
    """Logistic regression on standardised features, with Platt's calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        parts = [np.clip((rows - self.mean) / self.spread, -8, 8) @ self.weights[:-1] for _, rows in blocks(x)]
        return self.slope * (np.concatenate(parts) + self.weights[-1]) + self.shift if parts else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float, mean: np.ndarray | float = 0.0, spread: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression with a ridge penalty, on standardised rows."""
    w, keep = np.zeros(x.shape[1] + 1), np.full(x.shape[1] + 1, ridge)
    keep[-1] = 1e-3
    for _ in range(12):
        curve, slope = np.diag(keep), -keep * w
        for at, rows in blocks(x):
            z = np.hstack([np.clip((rows - mean) / spread, -8, 8), np.ones((len(rows), 1))])
            p = sigmoid(z @ w)
            curve += (z * (p * (1 - p))[:, None]).T @ z
            slope += z.T @ (y[at] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean = sum(rows.sum(axis=0) for _, rows in blocks(x)) / len(x)
    spread = np.maximum(np.sqrt(sum(((rows - mean) ** 2).sum(axis=0) for _, rows in blocks(x)) / len(x)), 1e-3)
    return View(mean, spread, newton(x, y, 5.0, mean, spread))


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each view's calibrated probability, and that of both: their log odds add up, the prior's counts once."""
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(a + b - self.prior)


#: By view (0, 1) and label: the documents of which the view is surest, with the other view's features, surest first.
Surest = dict[tuple[int, int], list[tuple[int, np.ndarray]]]


def co_trained(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Callable[[list[View]], Surest]) -> CoTrained:
    """Co-training on labelled rows (y 0 or 1) and documents without labels, which surest() looks through.

    A fifth of the labelled rows is set aside for calibration. In every round, each view is fitted on its rows and hands
    the documents of which it is surest, with its label, to the other view.
    """
    held = np.arange(len(y)) % 5 == 4
    views = [text, meta]
    taken: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
    fitted: list[View] = []
    for _ in range(ROUNDS):
        fitted = []
        for x, more in zip(views, taken):
            labels = np.array([label for label, _ in more.values()], float)
            fitted.append(fit_view(np.vstack([x[~held], *[row[None] for _, row in more.values()]]), np.append(y[~held], labels)))
        found = surest(fitted)
        for (i, label), best in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
            for key, row in best:
                taken[1 - i].setdefault(key, (label, row))
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for view, x in zip(fitted, views):
        z = view.logit(x[held])
        view.slope, view.shift = newton(z[:, None], y[held], 1.0)
    return CoTrained(fitted[0], fitted[1], float(base))


def best_of(keys: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Places of the EXCHANGED surest distinct keys, surest first, ties by key; only those that are sure enough."""
    at = np.flatnonzero(sure >= SURE)
    at = at[np.lexsort((keys[at], -sure[at]))]
    return at[np.sort(np.unique(keys[at], return_index=True)[1])][:EXCHANGED]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> CoTrained:
    """co_trained() with the documents without labels as arrays."""
    pool, keys = (pool_text, pool_meta), np.arange(len(pool_text))

    def surest(fitted: list[View]) -> Surest:
        p = [sigmoid(v.logit(x)) if len(x) else np.zeros(0) for v, x in zip(fitted, pool)]
        return {(i, label): [(int(k), pool[1 - i][k]) for k in best_of(keys, p[i] if label else 1 - p[i])] for i in (0, 1) for label in (0, 1)}

    return co_trained(text, meta, y, surest)


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """key, doc_id, t, m (features as bytes of 32-bit floats) of the documents that have no label.

    The numbers of the labelled ones are broadcast if they are few, so that no text is shuffled to leave them out; else
    they are taken off by a join on what is much smaller than the texts.
    """
    few = known.count() <= MAX_KNOWN
    held = docs.sparkSession.sparkContext.broadcast(np.sort(known.select("doc_id").toArrow()["doc_id"].to_numpy()) if few else np.zeros(0, np.int64))
    key = F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            ids = batch.column("doc_id")
            batch = batch.filter(pa.array(~np.isin(ids.fill_null(0).to_numpy(), held.value) | ids.is_null().to_numpy(zero_copy_only=False)))
            if batch.num_rows:
                a = text_view(texts(batch)).astype("<f4")
                b = meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))).astype("<f4")
                rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (a, b)]
                yield pa.record_batch([batch.column("key"), batch.column("doc_id"), *rows], ["key", "doc_id", "t", "m"])

    pool = docs.select(key, "doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, "key long, doc_id long, t binary, m binary")
    return pool if few else pool.join(known.select("doc_id"), "doc_id", "left_anti")


def surest_of(pool: DataFrame, fitted: list[View]) -> Surest:
    """The EXCHANGED documents of each label of which each view is surest, out of all. Tasks give their own best, which are
    ranked in parts by key and then as a whole; what reaches the driver are 4 * EXCHANGED rows."""
    held = pool.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            x = [utf8(batch, c)[0].view("<f4").reshape(len(keys), -1) for c in ("t", "m")]
            for i in (0, 1):
                p = sigmoid(held.value[i].logit(x[i]))
                for label, sure in ((1, p), (0, 1 - p)):
                    at = best_of(keys, sure)
                    new = keys[at], sure[at], x[1 - i][at]
                    if (i, label) in best:
                        new = tuple(np.concatenate(pair) for pair in zip(best[i, label], new))
                        at = best_of(new[0], new[1])
                        new = tuple(values[at] for values in new)
                    best[i, label] = new
        for (i, label), (keys, sure, rows) in best.items():
            n = len(keys)
            yield pa.record_batch(
                [pa.array([i] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array(sure, pa.float64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["view", "label", "key", "sure", "other"],
            )

    out = pool.mapInArrow(run, "view int, label int, key long, sure double, other binary").withColumn("part", F.pmod("key", F.lit(64)))
    for by in (("view", "label", "part"), ("view", "label")):
        out = out.dropDuplicates(["view", "label", "key"]) if "part" in by else out
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "key"))
        out = out.withColumn("nth", nth).where(F.col("nth") <= EXCHANGED).drop("nth")
    found: Surest = {}
    for r in sorted(out.collect(), key=lambda r: (-r["sure"], r["key"])):
        found.setdefault((r["view"], r["label"]), []).append((r["key"], np.frombuffer(r["other"], "<f4")))
    return found


def features(docs: DataFrame, label: str) -> DataFrame:
    """Both views' features of few documents, as lists, with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            a = text_view(texts(batch)).astype(np.float32)
            b = meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))).astype(np.float32)
            lists = [pa.array(list(x), pa.list_(pa.float32())) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(label), *lists], ["doc_id", "label", "t", "m"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars", label).mapInArrow(run, "doc_id long, label int, t array<float>, m array<float>")


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """The classifier for documents (doc_id, text, lang, source, n_chars) and labels (doc_id, quality).

    At most MAX_LABELLED labelled documents are taken, those with the smallest hash of their doc_id; the driver holds their
    features only. The exchange of pseudo-labels looks through all documents without a label in every round; their features
    are staged. Rows equal in all columns count once there. None if there are fewer than ten labelled documents, or of one
    class.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    place = F.xxhash64("doc_id", F.lit(17))
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    # The sample is chosen by id first; texts are read for the chosen alone.
    chosen = ids.join(known, "doc_id").orderBy(place, "doc_id").limit(MAX_LABELLED)
    few = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = features(few, "quality").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    y = got["label"].to_numpy()
    matrix = lambda name: np.asarray(got[name].combine_chunks().flatten()).reshape(len(y), -1)
    t, m = matrix("t"), matrix("m")
    del got
    if len(y) < 10 or len(set(y)) < 2:
        return None
    pool = stage(unlabelled(docs, known))
    return co_trained(t, m, y.astype(float), lambda fitted: surest_of(pool, fitted))


SCORES = ("_p_text", "_p_meta", "_p", "_kept")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with their columns called c0, c1 ..., and SCORES."""
    small_batches(docs.sparkSession)
    names = docs.columns
    model = fit(pick(docs, "doc_id", "text", "lang", "source", "n_chars"), pick(labels, "doc_id", "quality"))
    at = {x: f"c{names.index(x)}" for x in ("text", "lang", "source", "n_chars")}
    held = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = plain.withColumns({x: F.lit(None).cast("double") for x in SCORES[:3]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in chunks(batches, at["text"], 1 << 18):
            if model is None:
                yield batch
                continue
            t = text_view(texts(batch, at["text"]))
            m = meta_view(*(batch.column(at[c]).to_pylist() for c in ("lang", "source", "n_chars")))
            scores = [pa.array(x) for x in model.score(t, m)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *scores], batch.schema.names)

    return out.mapInArrow(run, out.schema).withColumn("_kept", F.coalesce(F.col("_p") >= THRESHOLD, F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (any columns; doc_id, text, lang, source and n_chars are used) with _p_text, _p_meta, _p (the
    probability of good quality) and _kept added.

    Two classifiers, one of the text's content and one of the page's metadata, are co-trained (fit()) on a documented
    sample; their calibrated views are combined to score every whole text, in the tasks that read them, without a shuffle.

    Cases: a null text is empty, other nulls are a value of their own. Without enough labels, probabilities are null and
    all is kept. Columns of docs that are called like an added one are left out. Repeated rows are all returned; an empty
    table gives an empty result.
    """
    out = scored(docs, labels)
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns) if x.lower() not in SCORES], *SCORES)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, with all of their columns and no other."""
    return scored(docs, labels).where("_kept").drop(*SCORES).toDF(*docs.columns)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_p_text").alias("p_text"), F.col("_p_meta").alias("p_meta"), F.col("_p").alias("score"), F.col("_kept").alias("kept"))
