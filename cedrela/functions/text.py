"""Text kernel: column functions that stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to (n with tilde becomes n).
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: The blanks that SQL trims: all of Unicode's spaces.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it. Catalyst would put the whole expression in each place."""
    return F.element_at(F.transform(F.array(x), f), 1)


def held(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with further columns whose values are computed once, however often later columns and filters use them. Of a plain
    column Catalyst would put the expression in each place, of an exploded one it can't."""
    for name, value in values.items():
        rows = rows.select("*", F.explode(F.array(value)).alias(name))
    return rows


def fold(x: Column) -> Column:
    """Lower case without accents, blanks collapsed, trimmed: the form that rules compare."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), r"\s+", " "))


def fold_only(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


@cache
def _accents() -> tuple[str, str]:
    """All letters with accents beside what they are without, then the marks that only stand as accents."""
    marks = lambda x: [c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M"]
    plain = {x: unicodedata.normalize("NFC", "".join(marks(x))) for x in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(x) != "Cs"}
    letters, alone = [x for x, y in plain.items() if y and y != x], [x for x, y in plain.items() if not y]
    return "".join(letters + alone), "".join(plain[x] for x in letters)


def fold_accents(x: Column) -> Column:
    """Lower case without any accents, those that stand as marks of their own included: strip_accents(lower(x)) in SQL."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(F.lower(x), *_accents()))


def as_sql(pattern: str) -> str:
    """A pattern as SQL reads it: only a line feed ends a line, and blanks are ASCII's without the vertical tab."""
    return "(?d)" + pattern.replace(r"\s", r"[ \t\n\f\r]")


def fold_only_text(x: Column) -> Column:
    """fold_only() of a plain column of long texts: those without accents, of as many bytes as letters, have nothing to translate."""
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(fold_only(x))


def holds_any(x: Column, words: Iterable[str]) -> Column:
    """Whether one of the words stands in x, as part of a word, too: quicker than a pattern on long texts."""
    return reduce(or_, (F.contains(x, F.lit(w)) for w in words))


def vocabulary_key(x: Column) -> Column:
    """Upper-case A-Z and digits only."""
    return F.upper(F.regexp_replace(fold(x), "[^a-z0-9]", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def similar(x: Column, term: str, least: float) -> Column:
    """Whether similarity(x, term) is `least` or more. Texts differ by their lengths' difference at least, so edits are only counted
    where lengths allow the score."""
    shorter, longer = F.least(F.length(x), F.lit(len(term))), F.greatest(F.length(x), F.lit(len(term)))
    return (1 - (longer - shorter) / longer >= least) & (similarity(x, F.lit(term)) >= least)


def best_match(x: Column, terms: list[str], least: float = 0.82) -> Column:
    """struct(term, score) of the most similar term from `least` on, the first of equals; else null. A list of fixed terms.
    Only terms whose length allows such a score are compared: two texts differ by their lengths' difference at least."""

    def fits(t: str) -> Column:
        shorter, longer = F.least(F.length(x), F.lit(len(t))), F.greatest(F.length(x), F.lit(len(t)))
        return (longer == 0) | (1 - (longer - shorter) / longer >= least)

    scored = [F.when(fits(t), F.struct(similarity(x, F.lit(t)).alias("score"), F.lit(-i).alias("place"), F.lit(t).alias("term"))) for i, t in enumerate(terms)]
    return bind(F.array_max(F.array(*scored)), lambda best: F.when(best["score"] >= least, F.struct(best["term"].alias("term"), best["score"].alias("score"))))


def strip_bullets(x: Column) -> Column:
    x = F.regexp_replace(x, r"^[\s•●▪◦*·–—-]+", "")
    return F.trim(F.regexp_replace(x, r"^[0-9]{1,2}[.)]\s*", ""))


def strip_years(x: Column) -> Column:
    """Drops ranges of years in brackets, then loose years and the separators they leave."""
    x = F.regexp_replace(x, r"\(\s*(19|20)[0-9]{2}[^)]*\)", " ")
    x = F.regexp_replace(x, r"(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])", "$1 $3")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ ,;-]+|[ ,;-]+$", ""))


def word_count(x: Column) -> Column:
    """Tokens with a letter or digit (ASCII, after folding)."""
    return F.size(F.filter(F.split(fold_only(x), r"\s+"), lambda t: t.rlike("[a-z0-9]"))).cast("long")


def keyword_score(x: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the phrases that stand in x; substrings count on purpose."""
    out = F.lit(0)
    for phrase, weight in weights.items():
        out = out + F.when(F.contains(x, F.lit(phrase)), weight).otherwise(0)
    return out


def clean_punctuation(x: Column) -> Column:
    """Uniform dashes, quotes and bars; runs of blanks become one. Line ends stay: rules below read lines."""
    x = F.translate(x, "–—―“”„‘’´`¦｜", "---\"\"\"''''||")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def glyph_repair(x: Column) -> Column:
    """In words of digits and look-alikes with a digit: O to 0, I and l to 1, S to 5, bars and tildes to hyphens."""
    numeric = x.rlike(r"^[0-9OoIlS.,/|~-]+$") & x.rlike("[0-9]")
    return F.when(numeric, F.translate(x, "OoIlS|~", "00115--")).otherwise(x)


def camel_to_snake(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"))


def key_hash(x: Column) -> Column:
    return F.concat(F.lit("sha256-"), F.sha2(x, 256))


def confidence_level(confidence: Column, text: Column) -> Column:
    """alta, media, baja or critica by confidence and length."""
    n = F.length(F.trim(text))
    return F.when((n < 40) | (confidence < 0.4), "critica").when(confidence < 0.6, "baja").when((confidence < 0.8) | (n < 200), "media").otherwise("alta")


def unintelligible(text: Column) -> Column:
    """struct(flag, reason) for text from recognition: long runs of one character in over 30 % of the lines, many long words
    without vowels, few words with two vowels in a row, or nothing at all."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    runs = lambda ls: F.size(F.filter(ls, lambda x: x.rlike(r"(.)\1{3,}"))) > 0.3 * F.size(ls)
    tokens = F.filter(F.split(fold_only(text), r"\s+"), lambda t: t.rlike("[a-z]"))

    def by_words(ts: Column) -> Column:
        odd = F.size(F.filter(ts, lambda t: (F.length(t) > 6) & ~t.rlike("[aeiou]")))
        voiced = F.size(F.filter(ts, lambda t: t.rlike("[aeiou].*[aeiou]")))
        return F.when((F.size(ts) > 9) & (odd > 3), "sin_vocales").when((F.size(ts) > 10) & (voiced < 0.25 * F.size(ts)), "pocas_palabras")

    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "vacio").when(bind(lines, lambda ls: (F.size(ls) > 0) & runs(ls)), "repeticion").otherwise(bind(tokens, by_words))
    return bind(reason, lambda r: F.struct(r.isNotNull().alias("flag"), r.alias("reason")))


#: Fixed thresholds and shapes of data that forms hold.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+?[0-9][0-9() .-]{5,17}[0-9]"
LONG_NUMBER = r"[0-9]{7,11}"
SHORT_DATE = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"


def data_hits(text: Column) -> Column:
    """How many different pieces of data the text has: e-mails, phones, numbers, dates."""
    each = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (EMAIL, PHONE, LONG_NUMBER, SHORT_DATE)]
    return F.size(F.array_distinct(F.transform(F.concat(*each), lambda x: F.regexp_replace(x, r"\s", "")))).cast("long")
