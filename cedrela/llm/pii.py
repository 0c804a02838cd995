"""Personal data: fixed patterns, and terms that give protected entities away."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pick, small_batches, stage, table, texts

KINDS = ("email", "ip", "card", "phone")
ORDER = {kind: i for i, kind in enumerate((*KINDS, "removed", "general"))}

# The patterns are those of the contract, so written that no text takes more than linear time.
EMAIL_END = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # an address is four parts of such a chain
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{4,}")

#: So many terms before and after an entity are its context.
REACH = 6
#: A term is tested if it stands beside one entity in so many documents.
MIN_DOCS = 2
#: From what share of a term's documents hold the entity beside it the term is generalised, and removed.
GENERALISE, REMOVE = 0.5, 0.9
#: A term tells so many bits about an entity at least: it makes it four times as likely.
MIN_BITS = 2.0
#: Flagged terms that are broadcast, some 100 bytes each. With more, they are joined to the texts' own terms.
TERM_PART = 200_000


def luhn(digits: str) -> bool:
    odd, even = map(int, digits[-1::-2]), (2 * int(x) for x in digits[-2::-2])
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted by start, then kind in the order of KINDS."""
    out = []
    if "@" in text:
        past = 0
        for m in EMAIL_END.finditer(text):
            at = m.start()
            while at > past and text[at - 1] in EMAIL_CHAR:
                at -= 1
            if at < m.start():
                out.append((at, m.end(), "email"))
                past = m.end()
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in four):
                out.append((at, end, "ip"))
            at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def entity_of(kind: str, text: str) -> str:
    """What makes two mentions the same entity: letters in lower case, or the digits."""
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else ''.join(c for c in text if c.isdigit())}"


def terms_of(text: str) -> set[str]:
    """The terms of a text, each in lower case by itself: in a text as a whole, a letter may become two."""
    return {*TERM.findall(text.lower())} if text.isascii() else {w.lower() for w in {*TERM.findall(text)}}


def beside(text: str, spans: list[tuple[int, int, str]]) -> set[tuple[str, str]]:
    """(term, entity) of the REACH terms before and after an entity, however far; words that are part of it don't count."""
    terms = list(TERM.finditer(text))
    starts, ends = [w.start() for w in terms], [w.end() for w in terms]
    out = set()
    for start, end, kind in spans:
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        near = terms[max(0, before - REACH) : before] + terms[after : after + REACH]
        entity = entity_of(kind, text[start:end])
        out.update((w.group().lower(), entity) for w in near)
    return out


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, share: terms that reveal an entity.

    One pass over all texts counts documents: of each term, of each entity, of both where the term stands beside the
    entity, and all; tasks add up before the shuffle. A term's share is P(entity beside it | term in the document), and it
    tells log2(share / P(entity)) bits about the entity. Pairs count that stand in MIN_DOCS documents or more. A term
    is returned, with its largest share, if for some entity the share is GENERALISE or more and the bits MIN_BITS or more: an
    entity that stands in many documents anyway isn't given away by what stands beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()
        documents: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [((term, ""), n) for term, n in documents.items()] + list(held.items())
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                ts, es = zip(*(k for k, _ in part))
                yield pa.RecordBatch.from_arrays([pa.array(ts), pa.array(es), pa.array([n for _, n in part], pa.int64())], ["term", "entity", "n"])
            held.clear()
            documents.clear()

        for batch in chunks(batches, "text", 1 << 20):
            for text in texts(batch):
                documents.update(terms_of(text))
                documents[""] += 1
                if spans := base_spans(text):
                    held.update(beside(text, spans))
                    held.update({("", entity_of(kind, text[a:b])) for a, b, kind in spans})
            if len(held) + len(documents) > 120_000:
                yield from flush()
        yield from flush()

    counts = docs.select("text").mapInArrow(run, "term string, entity string, n long")
    counts = stage(counts.groupBy("term", "entity").agg(F.sum("n").alias("n")))
    total = (counts.where("term = '' AND entity = ''").first() or {"n": 0})["n"]
    terms = counts.where("term != '' AND entity = ''").select("term", F.col("n").alias("n_term"))
    entities = counts.where("term = '' AND entity != ''").select("entity", F.col("n").alias("n_entity"))
    share = F.least(F.col("n") / F.col("n_term"), F.lit(1.0))
    both = counts.where(f"term != '' AND entity != '' AND n >= {MIN_DOCS}").join(terms, "term").withColumn("share", share).where(F.col("share") >= GENERALISE)
    bits = F.log2(F.col("share") * F.lit(float(total)) / F.col("n_entity"))
    return both.join(entities, "entity").where(bits >= MIN_BITS).groupBy("term").agg(F.max("share").alias("share"))


def spans_of(text: str, shares: dict[str, float]) -> str:
    """Base spans and those of flagged terms, as kind:start:end by commas."""
    taken = base_spans(text)
    new, k = [], 0
    if not shares or shares.keys().isdisjoint(terms_of(text)):
        return ",".join(f"{kind}:{start}:{end}" for start, end, kind in taken)
    for m in TERM.finditer(text):
        if (share := shares.get(m.group().lower())) is None:
            continue
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if not any(s[0] < m.end() and m.start() < s[1] for s in taken[k : k + len(KINDS)]):
            new.append((*m.span(), "removed" if share >= REMOVE else "general"))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(taken + new, key=lambda s: (s[0], ORDER[s[2]])))


def sanitised(text: str, spans: str) -> str:
    """The text with every span replaced: by its kind, or, for a term, by [term] (general) or nothing (removed).

    Of overlapping spans, the first to start is replaced, and what later ones have beyond it as well."""
    out, past = [], 0
    for x in spans.split(",") if spans else []:
        kind, start, end = x.split(":")
        start, end = int(start), int(end)
        if end <= past:
            continue
        out.append(text[past:start])
        out.append("" if kind == "removed" else "[term]" if kind == "general" else f"[{kind}]")
        past = end
    return "".join(out) + text[past:]


def shares_by_row(rows: DataFrame, text: str, flagged: DataFrame) -> DataFrame:
    """row, terms, shares: the flagged terms of each text that has any, by a join on the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text, 1 << 20):
            for row, x in zip(batch.column("row").to_pylist(), texts(batch, text)):
                own = pa.array(terms_of(x), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), own], ["row", "term"])

    own = rows.select("row", text).mapInArrow(run, "row long, term string")
    met = own.join(flagged, "term").groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("met"))
    return met.select("row", F.col("met.term").alias("terms"), F.col("met.share").alias("shares"))


FOUND = ("_spans", "_sanitised")


def scanned(docs: DataFrame) -> DataFrame:
    """The rows of docs with their columns called c0, c1 ..., and _spans and _sanitised."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    names = docs.columns
    at = f"c{names.index('text')}"
    flagged = stage(disclosing_terms(pick(docs, "doc_id", "text")))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    few = flagged.count() <= TERM_PART
    held = None
    if few:
        got = flagged.toArrow()
        held = spark.sparkContext.broadcast(dict(zip(got["term"].to_pylist(), got["share"].to_pylist())))
    else:
        rows = stage(plain.withColumn("row", F.monotonically_increasing_id()))
        plain = rows.join(shares_by_row(rows, at, flagged), "row", "left").select(*plain.columns, "terms", "shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at, 1 << 20):
            values = batch.column(at).to_pylist()
            if held is not None:
                shares = [held.value] * len(values)
            else:
                shares = [dict(zip(t or (), x or ())) for t, x in zip(*(batch.column(c).to_pylist() for c in ("terms", "shares")))]
            spans = [spans_of(text or "", x) for text, x in zip(values, shares)]
            clean = [None if text is None else sanitised(text, s) for text, s in zip(values, spans)]
            own = batch.select([f"c{i}" for i in range(len(names))])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(spans, pa.string()), pa.array(clean, pa.string())], [*own.schema.names, "_spans", "_sanitised"])

    out = plain.select(*[f"c{i}" for i in range(len(names))], *[F.lit(None).cast("string").alias(c) for c in FOUND]).schema
    return plain.mapInArrow(run, out)


def find(docs: DataFrame) -> DataFrame:
    """The rows of docs (any columns, with doc_id and text) with _spans (kind:start:end in code points, by commas) and
    _sanitised added.

    Base kinds are email, ip, card and phone. The method adds terms of which corpus co-occurrence says that they give a
    protected entity away (disclosing_terms()): general from a share of GENERALISE on, removed from REMOVE on. Their
    places are found in every text, whether or not it holds the entity. Up to TERM_PART flagged terms are broadcast; more
    are joined to the terms of each text, so no task or driver holds them all.

    Cases: a null text is empty, has no spans and stays null when sanitised. Repeated rows are all returned, and count as
    documents. Columns of docs that are called like an added one are left out. Texts are processed whole, in linear time. An
    empty table gives an empty result.
    """
    out = scanned(docs)
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns) if x.lower() not in FOUND], *FOUND)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns kept, with text sanitised (and n_chars, if there, brought up to date where spans are)."""
    names = docs.columns
    out = scanned(docs).withColumn(f"c{names.index('text')}", F.col("_sanitised"))
    if "n_chars" in names:
        size = f"c{names.index('n_chars')}"
        out = out.withColumn(size, F.when(F.col("_spans") != "", F.length("_sanitised").cast("long")).otherwise(F.col(size)))
    return out.drop(*FOUND).toDF(*names)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    each = F.split("_spans", ",")
    of = lambda kind: F.filter(each, lambda x: x.startswith(f"{kind}:"))
    base = F.filter(each, lambda x: F.substring_index(x, ":", 1).isin(*KINDS))
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.col("_spans").alias("spans"),
    )
