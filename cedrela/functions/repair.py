"""Repairs of recognised text: e-mails whose @ was misread, glued words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import plausible_email
from .shapes import DOMAIN_SHAPE, KNOWN_DOMAIN, joined_mail
from .text import EMAIL, bind, fold_only, holds_any

# Mail domains that are known, letters an @ is read as, and what words score.
DOMAINS = ["gmail", "hotmail", "outlook", "yahoo", "live", "icloud"]
GLYPHS = "cgoqe0a"
KNOWN, KNOWN_LONG, LONG, UNKNOWN = 8, 12, 5, -4
SEEDS = ["contrato", "termino", "fijo", "indefinido", "trabajador", "empleador", "periodo", "prueba", "salario", "labor", "cargo", "auxiliar", "liquidacion", "cesantias", "dobles", "vacaciones", "nombre", "cedula"]

PLAIN_LETTERS = str.maketrans("áéíóúüñ", "aeiouun")

_END = rf"((?:{'|'.join(DOMAINS)})\.[a-z]{{2,3}}(?:\.[a-z]{{2}})?)"


def email_in(text: Column, folded: Column | None = None) -> Column:
    """The e-mail of a text in lower case: as written; else with one or two misread letters before a known domain taken for
    the @; else a word, a blank and a known domain. Prose without a known domain stays without one. folded: fold_only(text), if
    it is there already."""
    x = fold_only(text) if folded is None else folded
    plain = F.nullif(F.lower(F.regexp_extract(text, EMAIL, 0)), F.lit(""))
    joined = lambda p: F.when(x.rlike(p), F.concat(F.regexp_extract(x, p, 1), F.lit("@"), F.regexp_extract(x, p, 2)))
    parted = rf"(?:^|[^a-z0-9._-])([a-z0-9][a-z0-9._-]*[a-z0-9])\s*[{GLYPHS}]{{1,2}}{_END}"
    blank = rf"(?:^|[^a-z0-9._-])([a-z0-9][a-z0-9._-]*[0-9._][a-z0-9._-]*)\s+{_END}"
    named = holds_any(x, DOMAINS)  # most texts name no domain, and are done with here
    return F.coalesce(F.when(F.contains(text, F.lit("@")), plain), F.when(named, F.coalesce(joined(blank), joined(parted))))


def split_glued(word: str, vocabulary: frozenset[str], longest: int) -> list[str]:
    """The parts of a glued word that score best: known words count by length, other letters cost; the word itself if fewer
    than two parts or nothing is gained."""
    folded = word.lower().translate(PLAIN_LETTERS)
    scores, came = [0.0], [-1]  # for each place the best score, and where the known word that ends there begins (-1: none does)
    for end in range(1, len(folded) + 1):
        best, at = scores[end - 1] + UNKNOWN, -1
        for begin in range(max(0, end - longest), end - 1):
            if (part := folded[begin:end]) in vocabulary and part != folded:
                score = scores[begin] + (KNOWN_LONG if end - begin >= LONG else KNOWN)
                if score > best:
                    best, at = score, begin
        scores.append(best)
        came.append(at)
    if scores[-1] <= 0:
        return [word]
    marks, end = {0, len(word)}, len(folded)
    while end > 0:
        if came[end] >= 0:
            marks |= {came[end], end}
        end = came[end] if came[end] >= 0 else end - 1
    cuts = sorted(marks)
    parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
    return parts if len(parts) >= 2 else [word]


def segmented(text: Column, seeds: list[str] | None = None) -> Column:
    """struct(text, n): words of seven letters or more split where they glue known words: the seeds and the other words of
    the same text. Lines stay."""
    known = frozenset(seeds or SEEDS)

    @F.pandas_udf("text string, n int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            if t is None:
                out.append((None, 0))
                continue
            words = {w.lower().translate(PLAIN_LETTERS) for w in t.split()}
            vocabulary = known | {w for w in words if 2 <= len(w) < 7 and w.isalpha()}
            longest, n, lines = max(map(len, vocabulary), default=1), 0, []
            done: dict[str, list[str]] = {}  # a word of the text is cut once
            for line in t.split("\n"):
                parts = []
                for w in line.split(" "):
                    cut = done.get(w) or (done.setdefault(w, split_glued(w, vocabulary, longest)) if len(w) >= 7 and w.isalpha() else [w])
                    n += len(cut) - 1
                    parts += cut
                lines.append(" ".join(parts))
            out.append(("\n".join(lines), n))
        return pd.DataFrame(out, columns=["text", "n"])

    return run(text)


#: Letters and signs that an at sign is read as, in a rebuilt address.
AT_SIGNS = "CGOQE0©()@"


def rebuilt_email(text: Column, strict: bool = False) -> Column:
    """The first address, in lower case, that can be rebuilt from a text whose at sign was misread: line by line, first out of
    two neighbouring words (joined_mail()), then out of one word with the sign inside, its user and domain being ones.

    Within a word, each place from the left is tried; the domain must be known, or have the shape of one beside a user with a
    full stop. strict: the address must be plausible by itself, for texts without a label. Null where there is none.
    """
    words = lambda line: F.filter(F.split(line, r"[ \t]+"), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: joined_mail(F.element_at(w, i), F.element_at(w, i + 1), AT_SIGNS)))

    def inside(word: Column) -> Column:
        def cut(i: Column) -> Column:
            user, domain = F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))
            own = user.rlike("^[A-Za-z0-9_.+-]{2,}$") & user.rlike("[A-Za-z]")
            fits = domain.rlike(KNOWN_DOMAIN) | (domain.rlike(DOMAIN_SHAPE) & F.contains(user, F.lit(".")))
            return F.when(F.contains(F.lit(AT_SIGNS), F.substring(word, i + 1, F.lit(1))) & own & fits, F.concat(user, F.lit("@"), domain))

        return F.when(word.rlike(r"\.[A-Za-z]{2,}$") & (F.length(word) > 4), F.transform(F.sequence(F.lit(1), F.length(word) - 4), cut))

    none = F.array().cast("array<string>")
    of_line = lambda line: bind(words(line), lambda w: F.concat(F.coalesce(pairs(w), none), F.flatten(F.transform(w, lambda x: F.coalesce(inside(x), none)))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[A-Za-z0-9-]\.[A-Za-z]{2,}"))
    found = F.transform(F.flatten(F.transform(lines, of_line)), lambda x: F.lower(x))
    kept = F.filter(found, lambda x: x.isNotNull() & (plausible_email(x) if strict else F.lit(True)))
    return F.when(text.rlike(r"[A-Za-z0-9-]\.[A-Za-z]{2,}"), F.try_element_at(kept, F.lit(1)))
