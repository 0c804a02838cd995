"""Dictionaries of any size over texts: places, skills and job families as tables of terms, found in one pass."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

#: Letters of the terms in one automaton (some 100 bytes each in a worker); more terms take several passes.
BLOCK = 400_000
#: Rows of a table of terms that are broadcast; more are joined by a shuffle.
SENT = 200_000
#: Room for a letter in a transition's number.
LETTERS = 21


class Automaton:
    """Finds all terms in a text while it is read once (Aho and Corasick, 1975).

    go maps (state, letter) to a state, fail a state to that of its longest suffix which begins a term; ends has the terms
    that end in a state, more the next state by suffixes that has some.
    """

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        self.go: dict[int, int] = {}
        self.fail, self.more = [0], [0]
        self.ends: dict[int, list[int]] = {}
        below: list[list[int]] = [[]]
        for number, term in enumerate(self.terms):
            state = 0
            for letter in map(ord, term):
                key = state << LETTERS | letter
                if key not in self.go:
                    self.go[key] = len(self.fail)
                    below[state].append(letter)
                    for held, value in ((self.fail, 0), (self.more, 0), (below, [])):
                        held.append(value)
                state = self.go[key]
            if term:
                self.ends.setdefault(state, []).append(number)
        todo = deque([0])
        while todo:
            state = todo.popleft()
            for letter in below[state]:
                there = self.go[state << LETTERS | letter]
                todo.append(there)
                if state:
                    suffix = self.fail[state]
                    while suffix and suffix << LETTERS | letter not in self.go:
                        suffix = self.fail[suffix]
                    suffix = self.go.get(suffix << LETTERS | letter, 0)
                    self.fail[there] = suffix
                    self.more[there] = suffix if suffix in self.ends else self.more[suffix]

    def found(self, text: str, words: bool) -> Iterator[tuple[int, int]]:
        """(number of the term, its place) of every occurrence; words: only where no letter or digit (ASCII) adjoins it."""
        go, fail, ends, more, terms = self.go.get, self.fail, self.ends, self.more, self.terms
        alone = lambda at: not 0 <= at < len(text) or not (text[at].isascii() and text[at].isalnum())
        state = 0
        for at, letter in enumerate(map(ord, text), 1):
            while (there := go(state << LETTERS | letter)) is None and state:
                state = fail[state]
            state = there or 0
            held = state if state in ends else more[state]
            while held:
                for number in ends[held]:
                    first = at - len(terms[number])
                    if not words or alone(first - 1) and alone(at):
                        yield number, first
                held = more[held]


def occurrences(texts: DataFrame, terms: DataFrame, words: bool = True, block: int = BLOCK) -> DataFrame:
    """id, term, n, first: the terms (column term) that stand in each text (id, text), how often, and where first (from 0).

    Texts and terms are taken as they are: fold both before. The automaton of a block of terms is broadcast, its size is
    bounded by `block` letters; a dictionary beyond that is dealt into blocks by the terms' hash, with a pass for each.
    Null and empty texts and terms find nothing; rows of texts are independent, and terms that repeat count once.
    """
    spark = texts.sparkSession
    distinct = terms.select("term").where("term != ''").distinct().persist()
    try:
        n_blocks = -(-(distinct.agg(F.sum(F.length("term"))).first()[0] or 0) // block) or 1
        dealt = F.pmod(F.xxhash64("term"), F.lit(n_blocks))
        parts = [Automaton(sorted(r["term"] for r in distinct.where(dealt == i).collect())) for i in range(n_blocks)]
    finally:
        distinct.unpersist()
    kind = dict(texts.dtypes)["id"]
    out = None
    for part in parts:
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            terms = sent.value.terms
            for batch in batches:
                at, found, n, first = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    seen: dict[int, list[int]] = {}
                    for number, place in sent.value.found(text or "", words):
                        seen.setdefault(number, [0, place])[0] += 1
                    at += [i] * len(seen)
                    found += [terms[x] for x in seen]
                    n += [x for x, _ in seen.values()]
                    first += [x for _, x in seen.values()]
                ids = batch.column("id").take(pa.array(at, pa.int64()))
                yield pa.record_batch([ids, pa.array(found, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], ["id", "term", "n", "first"])

        one = texts.select("id", "text").mapInArrow(run, f"id {kind}, term string, n long, first long")
        out = one if out is None else out.unionByName(one)
    return out


def with_terms(found: DataFrame, terms: DataFrame, *on: str) -> DataFrame:
    """found, which may be many more rows than Spark expects of it, joined with what belongs to its terms. It is never
    broadcast; the terms are if they are few."""
    few = terms.limit(SENT + 1).count() <= SENT
    return found.join(F.broadcast(terms) if few else terms.hint("merge"), list(on))


def folded(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, fold(F.col(column)))


def first_place(texts: DataFrame, places: DataFrame) -> DataFrame:
    """id, place: the place (of a table, column place) that stands first in each text; of those that begin there the longest."""
    named = folded(places, "place", "term").groupBy("term").agg(F.min("place").alias("place"))
    met = with_terms(occurrences(folded(texts, "text", "text"), named), named, "term")
    return met.groupBy("id").agg(F.min_by("place", F.struct("first", -F.length("term"), "place")).alias("place"))


def tagged(texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """id, skills: the skills (of a table: nth, category, skill) that stand in each text as words, in the table's order."""
    terms = folded(taxonomy, "skill", "term")
    met = with_terms(occurrences(folded(texts, "text", "text"), terms), terms, "term")
    return met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "category", "skill"))), lambda x: F.struct(x["category"].alias("category"), x["skill"].alias("skill"))).alias("skills"))


def families(titles: DataFrame, terms: DataFrame, least: int = 5) -> DataFrame:
    """id, family: the family (of a table: term, family) whose term is the title (id, text), else that of the longest term of
    `least` letters or more in it, wherever it stands; ties go to the smaller term, then family.

    Equal titles are worked on once."""
    title = folded(titles, "text", "title")
    wanted = folded(terms, "term", "term").groupBy("term").agg(F.min("family").alias("family"))
    distinct = title.select("title").where("title != ''").distinct()
    exact = distinct.join(wanted, F.col("title") == F.col("term")).select("title", "family", F.lit(0).alias("way"), F.lit(0).alias("size"), "term")
    within = with_terms(occurrences(distinct.select(F.col("title").alias("id"), F.col("title").alias("text")), wanted.where(F.length("term") >= least), words=False), wanted, "term")
    both = exact.unionByName(within.select(F.col("id").alias("title"), "family", F.lit(1).alias("way"), (-F.length("term")).alias("size"), "term"))
    return title.join(both.groupBy("title").agg(F.min_by("family", F.struct("way", "size", "term")).alias("family")), "title").select("id", "family")


def rarest_words(texts: DataFrame, n: int) -> DataFrame:
    """id, word, docs: the n words of each text (id, text: folded) that the fewest texts have, ties by the word."""
    words = texts.select("id", F.explode(F.array_distinct(F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != ""))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("docs"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("docs", "word"))
    return words.join(counts, "word").withColumn("_nth", nth).where(F.col("_nth") <= n).select("id", "word", "docs")
