"""Removal of benchmark passages from training texts by a suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, kept_bytes, pick, runs, small_batches, stage, table

#: Consecutive item words that make a hit.
WINDOW = 10
#: Item words in one automaton: some 150 bytes each in a worker. Longer benchmarks take several passes.
BLOCK_WORDS = 400_000
#: Bytes of text in a batch.
BATCH = 1 << 20
WORDS = kept_bytes(bytes(range(97, 123)) + bytes(range(48, 58)))
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
SPANS = "array<struct<first:long,last:long>>"


class Automaton:
    """A generalised suffix automaton over the words of items.

    go maps (state, word) to the next state, link is a state's longest suffix in another state, length its longest string.
    `whole` gives the state that holds the window ending in a longer match; `of_window` the items of such a state; `short`
    the lengths and items of items shorter than a window, `nearest` the next suffix state that has such.
    """

    def __init__(self, items: Sequence[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.n = len(self.ids)
        self.go: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]  # words that lead on from each state; only building needs them

        def new(length: int, link: int, words: list[int]) -> int:
            self.length.append(length)
            self.link.append(link)
            out.append(words)
            return len(self.length) - 1

        def split(state: int, word: int, there: int) -> int:
            """`there` with only the strings up to one word longer than those of `state`, for all that came from there."""
            if self.length[there] == self.length[state] + 1:
                return there
            twin = new(self.length[state] + 1, self.link[there], list(out[there]))
            self.go.update((twin * self.n + w, self.go[there * self.n + w]) for w in out[there])
            self.link[there] = twin
            while state >= 0 and self.go.get(state * self.n + word) == there:
                self.go[state * self.n + word] = twin
                state = self.link[state]
            return twin

        for _, words in items:
            last = 0
            for word in map(self.ids.__getitem__, words):
                there = self.go.get(last * self.n + word)
                if there is not None:
                    last = split(last, word, there)
                    continue
                state, last = last, new(self.length[last] + 1, 0, [])
                while state >= 0 and (there := self.go.get(state * self.n + word)) is None:
                    self.go[state * self.n + word] = last
                    out[state].append(word)
                    state = self.link[state]
                if state >= 0:
                    twin = split(state, word, there)
                    self.link[last] = twin

        size = len(self.length)
        self.whole = [0] * size
        self.nearest = [0] * size
        self.of_window: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for item, words in items:
            state = 0
            for at, word in enumerate(map(self.ids.__getitem__, words), 1):
                state = self.go[state * self.n + word]
                if at >= window and item is not None:
                    held = state
                    while self.length[self.link[held]] >= window:
                        held = self.link[held]
                    self.of_window.setdefault(held, set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), item))
        for state in sorted(range(1, size), key=self.length.__getitem__):
            up = self.link[state]
            self.whole[state] = state if self.length[up] < window else self.whole[up]
            self.nearest[state] = up if up in self.short else self.nearest[up]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, the maximal runs of words that are hit (first, last), the items with windows there.

        The longest match that ends at each word is carried along; suffix links shorten it where it can't go on.
        """
        get, go, n, link, length, window, short = self.ids.get, self.go.get, self.n, self.link, self.length, self.window, self.short
        spans: list[tuple[int, int]] = []
        windows, shorts = set(), set()
        state = matched = at = 0
        for words in runs(text, WORDS):
            for at, word in enumerate(map(get, words), at):
                if word is None:
                    state = matched = 0
                    continue
                while (there := go(state * n + word)) is None and state:
                    state = link[state]
                    matched = length[state]
                if there is None:
                    continue
                state, hit = there, 0
                matched += 1
                if matched >= window:
                    hit = window
                    windows.add(self.whole[state])
                if short:
                    held = state if state in short else self.nearest[state]
                    while held:
                        for size, item in short[held]:
                            if size <= matched:
                                hit = max(hit, size)
                                shorts.add(item)
                        held = self.nearest[held]
                if hit:
                    first = at - hit + 1
                    while spans and spans[-1][0] >= first:
                        spans.pop()
                    if spans and spans[-1][1] >= first - 1:
                        first = spans.pop()[0]
                    spans.append((first, at))
            at += bool(words)
        return at, spans, {x for s in windows for x in self.of_window.get(s, ())} | (shorts - {None})


def pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """item_id (string), words (binary, one space between), n of the items with words. An item of more than `most` words
    comes in pieces that overlap by window - 1 words, so that no window is lost."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH):
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = [w for part in runs(text, WORDS) for w in part]
                for at in range(0, max(1, len(words) - window + 1), most):
                    own = words[at : at + most + window - 1]
                    rows += [(item, b" ".join(own), len(own))] if own else []
            ids, texts, n = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.binary()), pa.array(n, pa.int64())], ["item_id", "words", "n"])

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return pick(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), text).mapInArrow(cut, "item_id string, words binary, n long").distinct()


def scanned(docs: DataFrame, automaton: Automaton, carried: list[str]) -> DataFrame:
    """Of each row (with text as binary): the columns `carried`, n_words, spans, items."""
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    kept = list(dict.fromkeys([*carried, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in chunks(batches, "text", BATCH):
            n, where, items = zip(*[sent.value.scan(x) for x in batch.column("text").to_pylist()])
            where = pa.array([[{"first": a, "last": b} for a, b in x] for x in where], spans)
            found = [pa.array(n, pa.int64()), where, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.record_batch([*[batch.column(c) for c in carried], *found], [*carried, "n_words", "spans", "items"])

    types = dict(docs.dtypes)
    return docs.select(*kept).mapInArrow(run, "".join(f"{c} {types[c]}, " for c in carried) + f"n_words long, spans {SPANS}, items array<string>")


def joined_spans(spans: Column) -> Column:
    """Spans of several passes, touching ones as one."""
    last = lambda held: F.element_at(held, -1)
    grown = lambda held, x: F.struct(last(held)["first"].alias("first"), F.greatest(last(held)["last"], x["last"]).alias("last"))
    without = lambda held: F.slice(held, F.lit(1), F.size(held) - 1)
    step = lambda held, x: F.when((F.size(held) > 0) & (F.coalesce(F.try_element_at(held, F.lit(-1))["last"], F.lit(-2)) >= x["first"] - 1), F.concat(without(held), F.array(grown(held, x)))).otherwise(F.concat(held, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def contamination(docs: DataFrame, items: DataFrame, carried: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `carried` of each row of docs (text as binary, not null), n_words, spans (first and last word, from 0, of
    maximal runs of words that are hit), items (sorted ids).

    A word of a document is hit if it lies in an occurrence of `window` consecutive words of an item, or of a whole item of
    fewer words. An automaton is built from some `block_words` words, which bounds what is broadcast; more items make more
    automata, one after another, whose findings (few: only rows with hits) are put together by row.
    """
    held = stage(pieces(items, window, max(window, block_words // 4)))
    n_blocks = -(-(held.agg(F.sum("n")).first()[0] or 0) // block_words) or 1
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks))
    one = lambda b: Automaton([(r["item_id"], bytes(r["words"]).split(b" ")) for r in held.where(block == b).collect()], window)
    if n_blocks == 1:
        return scanned(docs, one(0), carried)
    docs = stage(docs.withColumn("row", F.monotonically_increasing_id()))
    passes = [stage(scanned(docs, one(b), ["row"]).where(F.lit(b == 0) | (F.size("spans") > 0))) for b in range(n_blocks)]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    all_of = lambda c: F.flatten(F.collect_list(c))
    found = found.groupBy("row").agg(F.max("n_words").alias("n_words"), joined_spans(all_of("spans")).alias("spans"), F.array_sort(F.array_distinct(all_of("items"))).alias("items"))
    return docs.select("row", *carried).join(found, "row").drop("row")


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, text as binary, empty where it is null."""
    return pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))


def n_hit(spans: Column | str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x["last"] - x["first"] + 1)


def without_spans(text: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    out, at, spans = [], 0, iter(spans)
    span = next(spans, None)
    for number, word in enumerate(WORD.finditer(text)):
        if span is None:
            break
        if number == span[0]:
            out.append(text[at : word.start()])
        if number == span[1]:
            at, span = word.end(), next(spans, None)
    return b"".join(out) + text[at:]


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, removed (boolean), kept_text of every document.

    Runs of hit words of at least min_words are cut out of the text; a document of whose words more than max_coverage are
    hit is removed as a whole (kept_text is then empty).

    Cases, here and in contamination(): null text has no words, and an item without words matches nothing. Documents are
    rows, so those that repeat a doc_id, or have none, are judged each by itself. Items that repeat an item_id count as one,
    an item without one makes hits but isn't listed. Other columns are ignored; no items: no hits; no documents: no rows.
    """
    small_batches(docs.sparkSession)
    found = contamination(whole(docs), items, ["doc_id", "text"], window, block_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, removed, spans in zip(*[batch.column(c).to_pylist() for c in ("text", "removed", "spans")]):
                far = [(x["first"], x["last"]) for x in spans if x["last"] - x["first"] + 1 >= min_words]
                kept.append("" if removed else (without_spans(text, far) if far else text).decode())
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_hit", "items", "removed")]
            yield pa.record_batch([*columns, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_hit", "items", "removed", "kept_text"])

    known = found.withColumn("n_hit", n_hit("spans"))
    known = known.withColumn("removed", F.col("n_hit") > F.col("n_words") * F.lit(max_coverage))
    return known.mapInArrow(cut, f"doc_id {dict(known.dtypes)['doc_id']}, n_words long, n_hit long, items array<string>, removed boolean, kept_text string")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = contamination(whole(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: Windows are compared as strings here.
OP13_SQL = rf"""
WITH item AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM item WHERE len(w) > 0
), item_window AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), doc AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), doc_window AS (
  SELECT doc, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM item_window))
), hit AS (SELECT doc, i, k, item_id FROM doc_window JOIN item_window USING (k, s)
), word AS (SELECT doc, count(DISTINCT place) AS n FROM (SELECT doc, unnest(range(i, i + k)) AS place FROM hit) GROUP BY doc
), found AS (SELECT doc, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, word.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc) LEFT JOIN found USING (doc)
"""
