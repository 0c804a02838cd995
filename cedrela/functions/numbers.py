"""Amounts, identity numbers and phones in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

AMOUNT = r"\$?\s*([0-9][0-9.,]{3,})"
LABELLED_ID = r"(?:cc|c\.c\.|cedula|identificacion|documento)(?:\s+de\s+ciudadania)?\s*(?:no\.?|n)?\s*[:#.-]?\s*([0-9][0-9. -]{5,13}[0-9])"
DOTTED_ID = r"(?:^|[^0-9.])([0-9]{1,3}(?:\.[0-9]{3}){2,3})(?:$|[^0-9.])"
BARE_ID = r"(?:^|[^0-9.])([0-9]{8,10})(?:$|[^0-9.])"
#: Stands in each of the three, and is quicker to look for.
ANY_ID = "[0-9][0-9. -]{5}"
YEARS = r"(?:19|20)[0-9]{2}\s*(?:-|a|al|hasta|to)\s*(?:(?:19|20)[0-9]{2}|presente|actualidad|actual|present)"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\) ?)?[0-9][0-9 .()-]{5,20}[0-9]"
TAX_ID = r"^[0-9]{1,3}(?:[.,][0-9]{3}){2}-[0-9]$"
SALARY = r"(?:salario|sueldo|remuneracion|asignacion)(?:\s+(?:basico|mensual|base))*\s*[:#.-]?\s*(?:de\s+)?\$?\s*([0-9][0-9., ]{3,}[0-9])"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def amount(x: Column) -> Column:
    """Pesos: dots and commas group thousands, two digits after the last one are cents and dropped; four digits at least."""
    plain = F.regexp_replace(F.regexp_replace(x, "[^0-9.,]", ""), "[.,][0-9]{2}$", "")
    number = digits(plain)
    return F.when((F.length(number) >= 4) & (F.length(number) <= 15), number.cast("long"))


def labelled_amount(folded: Column, label: str) -> Column:
    """The amount after a label (a pattern), over 0."""
    return positive(after_label(folded, label))


def after_label(folded: Column, label: str) -> Column:
    """What stands after a label and may be an amount, as written."""
    return _found(folded, rf"(?:{label})\s*[:#.-]?\s*{AMOUNT}")


def positive(written: Column) -> Column:
    found = amount(written)
    return F.when(found > 0, found)


def salary(folded: Column, repairs: dict[int, int] | None = None) -> Column:
    """The amount after a word for salary, over 1000; `repairs` replaces known misreadings."""
    found = amount(F.replace(_found(folded, SALARY), F.lit(" "), F.lit("")))
    for wrong, right in (repairs or {}).items():
        found = F.when(found == wrong, F.lit(right).cast("long")).otherwise(found)
    return F.when(found > 1000, found)


def expected_salary(text: Column) -> Column:
    n = digits(text)
    value = F.when(F.length(n).between(1, 11), n.cast("long"))
    return F.when(value.between(200_000, 99_000_000), value)


def document_in_text(folded: Column) -> Column:
    """An identity number: after a label (7 to 11 digits), else dotted, else bare, the last two not starting with 3."""
    free = lambda x: bind(x, lambda v: F.when(~v.startswith("3") & F.length(v).between(7, 11), v))
    labelled = bind(digits(_found(folded, LABELLED_ID)), lambda v: F.when(F.length(v).between(7, 11), v))
    return F.when(folded.rlike(ANY_ID), F.coalesce(labelled, free(digits(_found(folded, DOTTED_ID))), free(_found(folded, BARE_ID))))


def phone(text: Column, other_than: Column | None = None) -> Column:
    """The first phone: 7 to 15 digits, no range of years, no tax id, not the number `other_than`. A run of more digits is
    two phones that a hyphen joins, of which the first valid counts."""
    plain = F.regexp_replace(F.lower(text), YEARS, " ")
    each = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(PHONE), F.lit(0)), lambda x: F.when(F.length(digits(x)) > 15, F.split(x, r"\s*-\s*")).otherwise(F.array(x))))
    each = F.transform(each, lambda x: F.trim(F.regexp_replace(x, r"[ .()-]+$", "")))

    def valid(x: Column) -> Column:
        fine = F.length(digits(x)).between(7, 15) & ~x.rlike(TAX_ID)
        return fine if other_than is None else fine & (digits(x) != F.coalesce(other_than, F.lit("")))

    return F.try_element_at(F.filter(each, valid), F.lit(1))
