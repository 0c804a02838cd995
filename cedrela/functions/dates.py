"""Dates as documents write them. Patterns expect folded text and work alike in Java and RE2."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

#: Months and numbers as words.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
NUMBERS = [
    "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "dieciseis",
    "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidos", "veintitres", "veinticuatro", "veinticinco", "veintiseis",
    "veintisiete", "veintiocho", "veintinueve", "treinta", "treinta y uno",
]
MONTH_NUMBER = {m: i for i, m in enumerate(MONTHS, 1)} | {"setiembre": 9}
DAY_NUMBER = {w: i for i, w in enumerate(NUMBERS, 1)} | {"primero": 1, "primera": 1}

_words = "|".join(sorted(DAY_NUMBER, key=lambda w: -len(w)))
TEXTUAL = rf"([0-9]{{1,2}}|{_words})\s+de\s+({'|'.join(MONTH_NUMBER)})\s+(?:de|del)\s+([0-9]{{4}})"
WHOLE = r"^([0-9]{1,4})[/-]([0-9]{1,2})[/-]([0-9]{1,4})$"
DAY_FIRST = r"(?:^|[^0-9/-])([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}|[0-9]{2})(?:$|[^0-9/-])"
YEAR_FIRST = r"(?:^|[^0-9/-])([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})(?:$|[^0-9/-])"
YEAR = r"(?:19|20)[0-9]{2}"
PRESENT = "presente|actualidad|actual|hoy|present|current|now"
MONTH_WORD = r"(?:ene|feb|mar|abr|may|jun|jul|ago|sep|set|oct|nov|dic|jan|apr|aug|dec)[a-z]*\.?\s+(?:de\s+)?"
END = rf"(?:{MONTH_WORD})?(?:[0-9]{{1,2}}\s*[/-]\s*)?({YEAR})"
RANGE = rf"{END}\s*(?:-|a|al|hasta|to)\s*(?:{END}|({PRESENT}))"
TERM = r"(?:duracion|termino|plazo|periodo)\s*(?:del\s+contrato)?\s*(?:de|:)?\s*([0-9]{1,3})\s*\(?\s*mes"


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def iso(year: Column, month: Column, day: Column) -> Column:
    """The date as text, or null if there is none such."""
    return F.date_format(F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _match(text: Column, pattern: str, f: Callable[[Column], Column], fits: Column | None = None) -> Column:
    """f of what the pattern matches first, null without one. The text is searched once, and only where it `fits`; the groups
    are those of the short match, which the pattern matches alike."""
    found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return bind(found if fits is None else F.when(fits, found), f)


def full_year(text: Column) -> Column:
    return F.when(F.length(text) == 2, F.concat(F.lit("20"), text)).otherwise(text)


def textual_date(folded: Column) -> Column:
    """`1 de mayo de 2023`, `primero de mayo del 2023`."""

    def date(found: Column) -> Column:
        word = _part(found, TEXTUAL, 1)
        day = F.coalesce(F.try_to_number(word, F.lit("99")).cast("int"), _lookup(DAY_NUMBER, word))
        return iso(_part(found, TEXTUAL, 3), _lookup(MONTH_NUMBER, _part(found, TEXTUAL, 2)), day)

    return _match(folded, TEXTUAL, date, reduce(or_, (F.contains(folded, F.lit(m)) for m in MONTH_NUMBER)))


def normal_date(folded: Column) -> Column:
    """Form A: a textual date anywhere, else the whole text as d/m/y (two-digit years are 20yy) or y/m/d."""
    x = F.trim(folded)
    a, b, c = (_part(x, WHOLE, k) for k in (1, 2, 3))
    whole = F.when(F.length(a) == 4, iso(a, b, c)).when(F.length(a) <= 2, iso(full_year(c), b, a))
    return F.coalesce(textual_date(x), whole)


def repair_year(year: Column) -> Column:
    """A year out of 1900 to 2100 with its first digit replaced by 1 or 2, if just one of them fits; else null."""
    one, two = 1000 + year % 1000, 2000 + year % 1000
    fits = lambda y: y.between(1900, 2100)
    return F.when(fits(year), year).when(fits(one) & ~fits(two), one).when(fits(two) & ~fits(one), two)


def loose_date(folded: Column) -> Column:
    """Form B: anywhere in the text; ranges are checked and the year's first digit is repaired."""
    x = F.trim(folded)
    number = lambda c: F.expr("try_cast(NULL AS INT)") if c is None else c.cast("int")
    y = _match(x, YEAR_FIRST, lambda m: iso(repair_year(number(_part(m, YEAR_FIRST, 1))), _part(m, YEAR_FIRST, 2), _part(m, YEAR_FIRST, 3)))
    d = _match(x, DAY_FIRST, lambda m: iso(repair_year(number(full_year(_part(m, DAY_FIRST, 3)))), _part(m, DAY_FIRST, 2), _part(m, DAY_FIRST, 1)))
    return F.coalesce(textual_date(x), y, d)


def first_date(text: Column) -> Column:
    """The first d/m/y of a text as y-m-d, not checked against the calendar."""
    pad = lambda m, k: F.lpad(_part(m, DAY_FIRST, k), 2, "0")
    return _match(text, DAY_FIRST, lambda m: F.concat(full_year(_part(m, DAY_FIRST, 3)), F.lit("-"), pad(m, 2), F.lit("-"), pad(m, 1)))


def add_months_overflow(day: Column, months: Column) -> Column:
    """Months added as calendars of scripting languages do: January 31 and one month is March 3 (or 2)."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.day(day) - 1)


def months_between(start: Column, end: Column) -> Column:
    """Whole months by year and month; one more when the end's month is the smaller number; null under one."""
    n = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    n = n + F.when(F.month(end) < F.month(start), 1).otherwise(0)
    return F.when(n >= 1, n)


def term_months(folded: Column) -> Column:
    """The months of a contract's term, 1 to 120."""
    n = _part(folded, TERM, 1).cast("int")
    return F.when(n.between(1, 120), n)


def date_range(folded: Column) -> Column:
    """struct(start, end, current): the years of a range; end is Actual for one that goes on."""

    def span(found: Column) -> Column:
        now = _part(found, RANGE, 3).isNotNull()
        return F.struct(_part(found, RANGE, 1).alias("start"), F.when(now, "Actual").otherwise(_part(found, RANGE, 2)).alias("end"), now.alias("current"))

    return _match(folded, RANGE, span, folded.rlike(YEAR))


def last_year(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(YEAR), F.lit(0)), F.lit(-1))
