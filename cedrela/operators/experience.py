"""Jobs of a CV around the ranges of dates that its lines have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, shapes
from ..functions.text import fold_only, held, strip_bullets

#: Lines above and below a range in which company and job are looked for, and below it the duties.
ABOVE, BELOW, DUTIES = 4, 3, 6
BULLET = r"^\s*(?:[•●▪◦*·‣>–—-]|[0-9]{1,2}[.)])\s*"


def without_range(text: Column) -> Column:
    """A line without its first range of dates, and without the signs that are left at its ends; null if nothing is left."""
    at = F.regexp_instr(fold_only(text), F.lit(dates.RANGE))
    size = F.length(F.regexp_extract(fold_only(text), dates.RANGE, 0))
    rest = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + size, F.length(text)))).otherwise(text)
    clean = F.regexp_replace(F.regexp_replace(rest, r"[\s|,;:()–—-]+$|^[\s|,;:()–—-]+", ""), r"\s{2,}", " ")
    return F.nullif(F.trim(clean), F.lit(""))


def _until(rows: Column) -> Column:
    """The elements before the first that has a range itself."""
    stop = F.array_position(F.transform(rows, lambda r: r["ranged"]), True)
    return F.when(stop > 0, F.slice(rows, F.lit(1), (stop - 1).cast("int"))).otherwise(rows)


def _first(rows: Column, test) -> Column:  # noqa: ANN001  a function of a column
    return F.try_element_at(F.filter(F.transform(rows, lambda r: r["text"]), test), F.lit(1))


def jobs(rows: DataFrame) -> DataFrame:
    """doc_id, nth (from 1), company, position, start, end, is_current, duties of lines (doc_id, pos, text): one job for each line
    with a range of dates.

    What is left of the line may name both (`Company - Job`), the job, or the company. The other is the nearest line above (four
    at most, and none before another range) that can be it, else the nearest of three below; a company with a word of firms
    comes before one that only has the shape. Duties are the lines with bullets
    among the next six, up to the next range. Each line meets its neighbours in one window by document.
    """
    text = F.col("text")
    span = F.when(text.rlike(dates.YEAR), dates.date_range(fold_only(text)))
    marked = held(rows.select("doc_id", "pos", "text"), span=span).withColumn("row", F.struct("text", F.col("span.start").isNotNull().alias("ranged")))
    # Documents without a range have no jobs: their lines need no neighbours.
    marked = marked.withColumn("any", F.max("row.ranged").over(Window.partitionBy("doc_id"))).where("any").drop("any")
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = marked.withColumns({"up": F.reverse(F.collect_list("row").over(w.rowsBetween(-ABOVE, -1))), "down": F.collect_list("row").over(w.rowsBetween(1, DUTIES))}).where("span.start IS NOT NULL")
    near = near.select("doc_id", "pos", "span", without_range(text).alias("rest"), _until(F.col("up")).alias("up"), _until(F.col("down")).alias("down"))
    plain = lambda rows: F.filter(rows, lambda r: ~r["text"].rlike(BULLET))
    near = near.withColumns({"around": F.concat(plain(F.col("up")), plain(F.slice("down", 1, BELOW))), "both": shapes.company_and_job(F.coalesce("rest", F.lit("")))})
    is_firm = lambda x: shapes.is_company(x) & ~shapes.is_job(x)
    own_job, own_firm = F.when(shapes.is_job(F.coalesce("rest", F.lit(""))), F.col("rest")), F.when(is_firm(F.coalesce("rest", F.lit(""))), F.col("rest"))
    company = F.coalesce(F.col("both.company"), own_firm, _first(F.col("around"), lambda x: shapes.has_firm_word(x) & ~shapes.is_job(x)), _first(F.col("around"), is_firm))
    position = F.coalesce(F.col("both.position"), own_job, _first(F.col("around"), shapes.is_job), F.when(own_firm.isNull(), F.col("rest")))
    duties = F.transform(F.filter("down", lambda r: r["text"].rlike(BULLET)), lambda r: strip_bullets(r["text"]))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return near.select(
        "doc_id", nth.alias("nth"), strip_bullets(company).alias("company"), strip_bullets(position).alias("position"), F.col("span.start").alias("start"), F.col("span.end").alias("end"),
        F.col("span.current").alias("is_current"), duties.alias("duties"),
    )
