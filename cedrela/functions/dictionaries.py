"""Job families, places and skills as parameter tables. A deployment passes its own; these are short defaults."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, fold, holds_any

# Terms of each job family (folded).
FAMILIES = {
    "Servicios generales": ["servicios generales", "aseo y limpieza", "auxiliar de aseo", "aseador", "aseadora", "todero", "oficios varios"],
    "Auxiliar administrativo": ["auxiliar administrativo", "asistente administrativo", "auxiliar de oficina", "secretaria", "recepcionista", "auxiliar de archivo"],
    "Contable y financiero": ["auxiliar contable", "contador", "contadora", "analista contable", "auxiliar de nomina", "tesorero", "revisor fiscal"],
    "Talento humano": ["talento humano", "recursos humanos", "gestion humana", "reclutador", "jefe de personal"],
    "Operario de produccion": ["operario", "operaria", "operario de produccion", "auxiliar de produccion", "operador de maquina", "empacador", "auxiliar de empaque"],
}
PLACES = ["Bogotá", "Medellín", "Cali", "Barranquilla", "Cartagena", "Cúcuta", "Bucaramanga", "Santa Marta", "Villavicencio", "Pereira", "Pasto", "Manizales", "Villa del Rosario", "Los Patios", "Norte de Santander", "Santander"]
SKILLS = {
    "Lenguajes": ["python", "java", "javascript", "sql"],
    "Ofimatica": ["excel", "word", "power point", "outlook"],
    "Seguridad industrial": ["trabajo en alturas", "primeros auxilios", "seguridad industrial"],
    "Logistica": ["inventarios", "montacargas", "despacho"],
}


def _folded(x: str) -> str:
    return x.lower().translate(str.maketrans("áéíóúñ", "aeioun"))


def job_family(title: Column, families: dict[str, list[str]] | None = None) -> Column:
    """The family whose term is the title, else of the longest term (five letters or more) that stands in it; else null."""
    terms = sorted(((t, f) for f, ts in (families or FAMILIES).items() for t in ts), key=lambda p: (-len(p[0]), p[0]))
    exact = F.create_map(*[F.lit(v) for t, f in terms for v in (t, f)])
    within = lambda x: [F.when(F.contains(x, F.lit(t)), F.lit(f)) for t, f in terms if len(t) >= 5]
    return bind(fold(title), lambda x: F.coalesce(exact[x], *within(x)))


def bounded(term: str) -> str:
    return rf"(?:^|[^a-z0-9]){_folded(term)}(?:$|[^a-z0-9])"


def find_place(text: Column, places: list[str] | None = None, folded: bool = False) -> Column:
    """The place that stands first in the text; of those that begin there, the longest name. folded: the text has lower case and no
    accents already."""
    x = F.concat(F.lit(" "), F.regexp_replace(text if folded else fold(text), "[^a-z0-9]+", " "), F.lit(" "))
    if folded:  # most texts hold no place's first word, and are done with here
        x = F.when(holds_any(text, sorted({_folded(p).split()[0] for p in places or PLACES})), x)
    at = lambda x: [F.struct(F.instr(x, F.lit(f" {_folded(p)} ")).alias("at"), F.lit(-len(p)).alias("longest"), F.lit(p).alias("place")) for p in places or PLACES]
    return bind(x, lambda x: F.array_min(F.filter(F.array(*at(x)), lambda s: s["at"] > 0))["place"])


def fuzzy_place(text: Column, places: list[str] | None = None) -> Column:
    """Of single-word places, the one within an eighth of its letters (one at least) of a word of the text; the nearest,
    then the first in the text."""
    words = F.array_distinct(F.filter(F.split(fold(text), "[^a-z]+"), lambda w: F.length(w) >= 4))  # in the order of their first places
    single = [p for p in places or PLACES if " " not in p]

    def near(w: Column, i: Column) -> Column:
        # Edits beyond the bound aren't counted out: -1.
        d = lambda p: F.levenshtein(w, F.lit(_folded(p)), max(1, len(p) // 8))
        one = [F.when(d(p) >= 0, F.struct(d(p).alias("d"), i.alias("i"), F.lit(p).alias("place"))) for p in single]
        return F.array_min(F.array(*one))

    return F.array_min(F.transform(words, near))["place"]


def skills(text: Column, taxonomy: dict[str, list[str]] | None = None, folded: bool = False) -> Column:
    """array of (category, skill) whose terms stand in the text as words, in the taxonomy's order. folded: the text has lower case
    and no accents already."""
    each = lambda x: [F.when(F.contains(x, F.lit(s)) & x.rlike(bounded(s)), F.struct(F.lit(c).alias("category"), F.lit(s).alias("skill"))) for c, ss in (taxonomy or SKILLS).items() for s in ss]
    plain = fold(text)
    if folded:  # most texts hold no term's first word, and are done with here
        plain = F.when(holds_any(text, sorted({s.split()[0] for ss in (taxonomy or SKILLS).values() for s in ss})), F.regexp_replace(text, r"\s+", " ")).otherwise(F.when(text.isNotNull(), ""))
    return bind(plain, lambda x: F.array_compact(F.array(*each(x))))


def fuzzy_lookup(rows: DataFrame, column: str, terms: DataFrame, most: float = 0.18) -> DataFrame:
    """id, term, distance: each row's nearest term of a table of any size (term), within `most` of the longer length; ties go
    to the smaller term.

    A term that allows k edits is cut into k + 1 segments. One of them stands unchanged in each text within that distance, at
    most k places away: pairs meet by segment, and lengths and places are compared before the distance is. Equal texts and
    equal terms meet once, whatever the number of their rows. Null and empty texts and terms find nothing.
    """
    texts = rows.select(F.col(column).alias("x")).where("x != ''").distinct()
    wanted = terms.select("term").where("term != ''").distinct()
    # The longer text has at most n / (1 - most) letters, n those of the term.
    edits = F.floor(most * F.length("term") / (1 - most) + 1e-9).cast("int")
    cut = wanted.select("term", edits.alias("k"), F.posexplode(F.sequence(F.lit(0), edits)).alias("i", "_"))
    at = F.floor(F.col("i") * F.length("term") / (F.col("k") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * F.length("term") / (F.col("k") + 1)).cast("int")
    segments = cut.select("term", "k", at.alias("at"), F.substring("term", at + 1, end - at).alias("segment"))
    longest = F.lit(math.ceil((1 - most) / most) + 2)
    lengths = F.sequence(F.lit(1), F.least(F.length("x"), longest))
    places = texts.select("x", F.explode(lengths).alias("n")).select("x", "n", F.explode(F.sequence(F.lit(0), F.length("x") - F.col("n"))).alias("place"))
    places = places.select("x", "place", F.substring("x", F.col("place") + 1, F.col("n")).alias("segment"))
    near = (F.abs(F.col("place") - F.col("at")) <= F.col("k")) & (F.abs(F.length("x") - F.length("term")) <= F.col("k"))
    pairs = places.join(segments, "segment").where(near).select("x", "term").distinct()
    scored = pairs.withColumn("distance", F.levenshtein("x", "term")).where(F.col("distance") <= most * F.greatest(F.length("x"), F.length("term")) + 1e-9)
    best = scored.groupBy("x").agg(F.min(F.struct("distance", "term")).alias("b"))
    return rows.select("id", F.col(column).alias("x")).join(best, "x").select("id", F.col("b.term").alias("term"), F.col("b.distance").alias("distance"))
