"""How much a reading of a page gives to the forms, and which of several readings is best."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, fold

# The vocabulary of forms, without accents, and the shapes of data that forms hold.
VOCABULARY = (
    "datos personales", "datos de contacto", "informacion personal", "perfil profesional", "perfil laboral", "resumen profesional", "objetivo laboral", "experiencia laboral", "experiencia profesional",
    "trayectoria laboral", "formacion academica", "estudios realizados", "nivel educativo", "habilidades", "competencias", "idiomas", "referencias personales", "certificaciones", "nombre completo", "apellidos",
    "cedula", "documento de identidad", "identificacion", "telefono", "celular", "movil", "whatsapp", "correo electronico", "direccion de residencia", "ciudad de residencia", "domicilio", "nacionalidad",
    "estado civil", "fecha de nacimiento", "lugar de nacimiento", "aspiracion salarial", "disponibilidad", "salario", "sueldo", "empresa", "cargo", "experiencia", "formacion", "educacion",
)
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre"
MAIL, SPACED_MAIL = r"[\w.+-]+@[\w.-]+\.\w{2,}", r"[\w.+-]+@[\w.-]+\s*\.\s*\w{2,}"
PHONE = r"\b\d{3}[\s.-]?\d{3}[\s.-]?\d{4}\b"
GROUPED = r"\b\d{1,3}(?:[.\s]\d{3}){2,}\b"
IDENTITY = r"(?i)\b(?:C\.?C\.?|CC|CO)\s*\d{6,10}\b"
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
WRITTEN_DATE, LOOSE_WRITTEN_DATE = rf"(?i)\b\d{{1,2}}\s+(?:de\s+)?(?:{MONTHS})\s+(?:de\s+)?\d{{4}}\b", rf"(?i)\b\d{{1,2}}\s+(?:de\s+)?(?:{MONTHS})\s*(?:de\s+)?\d{{4}}\b"
AMOUNT = r"\$\s*\d{1,3}(?:[.,]\d{3})+"
FORM_DATA = (MAIL, PHONE, GROUPED, DATE, WRITTEN_DATE, AMOUNT)
READING_DATA = (SPACED_MAIL, PHONE, GROUPED, IDENTITY, DATE, LOOSE_WRITTEN_DATE, AMOUNT)

#: A reading is solid from so many characters and such a confidence on.
SOLID_LENGTH, SOLID_CONFIDENCE = 400, 0.8
#: From such a share of labelled lines on, a text looks like a table.
TABLE_SHARE = 0.15
LABELLED = r"^[^:\n]{2,35}:(?:\s*$|\s+\S)"


def coverage(text: Column) -> Column:
    """How many terms of the vocabulary stand in the text, whatever their accents."""
    return bind(fold(text), lambda x: sum((F.contains(x, F.lit(t)).cast("int") for t in VOCABULARY), F.lit(0)))


def distinct_data(text: Column, shapes: tuple[str, ...]) -> Column:
    """How many distinct pieces of data of these shapes the text has, blanks aside. Texts without a digit or an @ have none."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in shapes])
    return F.when(text.rlike("[0-9@]"), F.size(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))))).otherwise(0)


def form_points(text: Column) -> Column:
    """Twice the distinct data of forms, and the coverage of their vocabulary."""
    return 2 * distinct_data(text, FORM_DATA) + coverage(text)


def reading_points(text: Column, confidence: Column) -> Column:
    """Length by confidence (0 to 1): much more text wins unless it is much less sure."""
    return F.length(F.trim(text)) * (0.5 + confidence / 2)


def is_solid(text: Column, confidence: Column) -> Column:
    return (F.length(F.trim(text)) >= SOLID_LENGTH) & (confidence >= SOLID_CONFIDENCE)


def is_labelled_table(text: Column) -> Column:
    """Whether so many lines are of the form `label: value` that the text comes from a table."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    return bind(lines, lambda x: (F.size(x) > 0) & (F.size(F.filter(x, lambda y: y.rlike(LABELLED))) >= TABLE_SHARE * F.size(x)))


# Of a probe the least characters, what is clear, how much better and how sure a turn must be; sizes of images.
PROBE_CHARS, CLEAR, MARGIN, LEAST_SURE = 60, 85, 10, 60
RENDER_DPI, PDF_DPI, RENDER_PIXELS, WORK_WIDTH, WORK_PIXELS = 300, 72, 4_500_000, 2400, 12_000_000


def render_scale(width: Column, height: Column) -> Column:
    """How much a page is enlarged to be read: to 300 dots an inch, less where that is too many pixels, 1.5 at least."""
    wanted = F.lit(RENDER_DPI / PDF_DPI)
    return F.when(width * height * wanted * wanted <= RENDER_PIXELS, wanted).otherwise(F.greatest(F.lit(1.5), F.sqrt(RENDER_PIXELS / (width * height))))


def working_scale(width: Column, height: Column) -> Column:
    """How much an image is enlarged to be worked on: to the wanted width, less where that is too many pixels, a quarter at least."""
    wanted = F.greatest(F.lit(1.0), WORK_WIDTH / width)
    return F.greatest(F.lit(0.25), F.when(width * height * wanted * wanted > WORK_PIXELS, F.sqrt(WORK_PIXELS / (width * height))).otherwise(wanted))


def plausible_turns(width: Column, height: Column) -> Column:
    """An upright page may be upside down; a lying one may be turned to either side."""
    return F.when(height >= width, F.array(F.lit(0), F.lit(180))).otherwise(F.array(F.lit(0), F.lit(90), F.lit(270)))


def probe_value(chars: Column, confidence: Column) -> Column:
    """A probe with hardly any text tells nothing, however sure it is."""
    return F.when(chars < PROBE_CHARS, 0.0).otherwise(confidence.cast("double"))
