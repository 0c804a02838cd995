"""CVs, contracts, e-mail repair and word segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import repair
from ..operators import parsers, people
from . import Catalogue, corpus

C = Catalogue()

CV = {
    101: "HOJA DE VIDA\nNombres: Ana María   Apellidos: Prueba López\nC.C. 12.345.678\nCiudad: Cúcuta, N. de S.\nCel: 301 555 1234\nana.prueba@example.org\nPERFIL PROFESIONAL\nPersona responsable con seis años en bodegas.\nEXPERIENCIA LABORAL\nTextiles Ejemplo SAS\nAuxiliar de bodega 2018 - 2021\nPlásticos Muestra LTDA\nOperaria 2021 a actualidad\nFORMACIÓN ACADÉMICA\nBachiller académico, Colegio Inventado 2012\nTécnico en logística SENA 2015\nIDIOMAS\nInglés básico\nEspañol nativo\nCURSOS\nTrabajo en alturas 2020\nREFERENCIAS\nLuis Ensayo 3105550101\nRosa Supuesta - 3155550102\n",
    102: "Pedro de la Muestra\nBarranquilla\nTel 6075550100\npedro.muestra99 gmail.com\nExperience\nIndustrias Modelo\nSupervisor 2010 - 2016\nSkills\nExcel, SQL\n",
    103: "",
}
CONTRACTS = {
    201: "CONTRATO INDIVIDUAL DE TRABAJO A TÉRMINO FIJO\nEmpleador: Industrias Ejemplo\nTrabajador: Pedro Muestra\nC.C. 23.456.789\nCargo: Operario de planta\nSalario básico: $ 1.423.500\nDuración: 6 meses\nFecha de inicio: 01/03/2024\nPeriodo de prueba: 2 meses\n",
    202: "Contrato a término indefinido\nEmpresa: Textiles Prueba\nTrabajador: Luz Ficticia\nSueldo: 2.000.000\nFecha de inicio: 2023-05-10\nPreaviso de 15 días\n",
    203: "Contrato de prestación de servicios\nFecha de inicio: 01/02/2022\nFecha de vencimiento: 01/08/2022\n",
}
EMAILS = ["escribir a ana.prueba@Example.org ya", "pedro.muestraCgmail.com", "luz_9 hotmail.com", "sin correo aqui", "rosaogmail.com", None, "cuenta: juan.s Gyahoo.com.co"]
GLUED = ["TERMINOFIJO del contrato", "CESANTIASDOBLES y vacaciones", "palabra normal", "nombrecedula\ncargoauxiliar", None, ""]


@C.add(aside=True)
def parse_cv(spark: SparkSession, d: str) -> DataFrame:
    return people.cv_records(spark.createDataFrame(list(CV.items()), "doc_id int, text string"))


@C.add()
def parse_cv_documents(spark: SparkSession, d: str) -> DataFrame:
    """The CV parser over all supplied documents, every field of its records; lists are JSON."""
    out = people.cv_records(views.read(spark, d, "documents")).withColumn("n_skills", F.size("skills"))
    return out.withColumns({c: F.to_json(c) for c, kind in out.dtypes if kind.startswith("array")})


@C.add(aside=True)
def parse_contract(spark: SparkSession, d: str) -> DataFrame:
    return people.contract_records(spark.createDataFrame(list(CONTRACTS.items()), "doc_id int, text string"))


@C.add(aside=True)
def email_repair(spark: SparkSession, d: str) -> DataFrame:
    return corpus.listed(spark, EMAILS).select("id", repair.email_in(F.col("x")).alias("email"))


@C.add(aside=True)
def segment_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.listed(spark, GLUED).select("id", repair.segmented(F.col("x")).alias("s")).select("id", "s.*")


FILLED = {"first_names": "full_name IS NOT NULL", "last_names": "city IS NOT NULL", "document_number": "document_number IS NOT NULL", "phone": "balance > 0", "email": "balance > 2000", "experience": "status = 'activo'", "education": "area = 'BUILDING'"}
_SUM = " + ".join(f"CASE WHEN {test} THEN {parsers.COMPLETENESS[k]} ELSE 0 END" for k, test in FILLED.items())


@C.add(
    f"""{views.with_views('employees')} SELECT id, CASE WHEN length(full_name || document_number || area || city) < 40 THEN least(s, 0.4) ELSE s END AS score
FROM (SELECT *, least(greatest(CAST(0.3 * (id % 10) / 10.0 + 0.7 * ({_SUM}) AS DOUBLE), 0.2), 1.0) AS s FROM employees)"""
)
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    e = views.employees(spark, d)
    filled = {k: F.coalesce(F.expr(test), F.lit(False)) for k, test in FILLED.items()}
    return e.select("id", parsers.completeness((F.col("id") % 10) / 10.0, filled, F.concat("full_name", "document_number", "area", "city")).alias("score"))
