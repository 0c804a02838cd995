"""Invented texts for rules that the supplied documents never meet. All people, numbers and firms are made up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = {
    1: "HOJA DE VIDA\nDatos personales\nNombres: Ana   Apellidos: Prueba\nCédula: 12.345.678\nCel: 301 555 1234\nExperiencia laboral\nContrato a término fijo, funciones propias del cargo\n",
    2: "CERTIFICADO DE AFILIACIÓN\nAfiliado: MARIO ENSAYO LOPEZ\nCédula 23456789\nNueva EPS régimen contributivo\nARL Positiva, pensiones Porvenir, caja Comfanorte\n",
    3: "REPÚBLICA DE COLOMBIA\nCédula de ciudadanía\nNúmero: 45.678.901\nApellidos: FICTICIA ROJAS\nNombres: LUZ MARINA\nFecha de nacimiento: 05-03-1990\nLugar de expedición: Cúcuta\n",
    4: "CONTRATO INDIVIDUAL DE TRABAJO a término fijo\nEmpleador: Industrias Ejemplo\nTrabajador: Pedro Muestra\nSalario básico: $ 1.423.500\nDuración: 6 meses\nPrimero de mayo de 2023\n",
    5: "LLAMADO DE ATENCIÓN No. 12\nPara: pedro muestra\nDe: jefe de planta\nAsunto: llegada tarde\nFecha: 12/05/2024\nSe le recuerda el horario.\n",
    6: "MEMORANDO No. 7\nPARA: Luz Ficticia\nDE: Gerencia\nASUNTO: Reunión\nSe convoca el 3 de abril de 2024.\nC.C. 34567890\n",
    7: "Carta de renuncia\nPresento mi renuncia al cargo de auxiliar desde el 04 de enero de 2025.\n",
    8: "LIQUIDACIÓN FINAL\nTrabajador: Rosa Inventada Diaz\nCédula: 56.789.012\nEmpresa: Textiles Prueba\nCargo: Operaria de planta\nFecha de ingreso: 01/02/2022\nFecha de retiro: 2023-08-15\nDías trabajados: 195\nSalario base: $ 1.300.000\nCesantías: 704.166\nIntereses: 45,771\nPrima de servicios: $ 216.667,00\nVacaciones: 352.083\nAuxilio de transporte 140.606\nBonificación especial: 250.000\nTotal a pagar: $ 3.009.293\n",
    9: "MANUAL DE FUNCIONES\nCargo: Auxiliar de bodega\n1. Recibir la mercancía.\n2) Llevar el inventario;\n- Firma\n• Despachar pedidos\n",
    10: "Bachiller, primaria y secundaria completas\nCédula 67890123\nCelular 3105550000\nCalle 4 # 5-60\nNacido el 2 de marzo de 1991\n",
    11: "",
    12: "contrato suelto del empleador con el trabajador\n",
    13: "Licencia de conducción de la República de Colombia, cédula de ciudadanía\n",
    14: "aaaaaaa\nbbbbbbb\nccccccc\nnada\n",
    15: "xkcdfgh qwrtpsd zxcvbnm plkjhgf a b c d e f g h\n",
    16: "Amonestación: uso del casco\npara: Juan Supuesto\nasunto: seguridad\n",
}
DATES = ["5/3/2024", "2024-03-05", "31/02/2024", "5-3-24", "primero de mayo de 2023", "04 ENERO 2025", "04 de Enero de 2025", "7025-01-02", "", "3024/02/01", "29 de febrero de 2023", "treinta y uno de diciembre del 1999", "firmado el 12/11/2022 aquí", None, "Marzo 2019 - Junio 2021", "2018 a actualidad", "03/2015 hasta 2016"]
AMOUNTS = ["$ 1.234.567", "1,234,567", "442,266.00", "3 200 000", "999", "text", "salario: $ 1.500.000", "sueldo básico mensual de 2,000,000.00", "423500", "$ 1.234", None, "expectativa 2500000", "99.000.001"]
IDS = ["CC 12.345.678", "cédula de ciudadanía No. 1.098.765.432", "3001234567", "tel 301 555 1234 y 7654321", "2015 - 2018", "3218055469 - 3002808775", "901.167.955-4", "documento: 123456", "sin datos", None, "+57 (601) 555 0199", "12345678", "12.345.678-9"]
NAMES = ["Ana", "Ana Prueba", "Ana María Prueba", "Ana María Prueba López", "Ing. Pedro de la Muestra", "Dra. Luz del Campo Rojas", "  ", "Rosa Inventada Díaz y Mora", "JOSÉ ÑÁÑEZ", "x1", None]
LEXICON = ["Auxiliar administrativo", "Servicios generales", "Talento humano", "Operario de produccion", "Contable y financiero"]
WORDS = ["auxiliar administrativ0", "servicio generales", "talento humnao", "operario", "Contable y Financiero", "", "zzz"]


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def sql_values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) v({names})"


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS.items()), "doc_id int, text string")


def listed(spark: SparkSession, values: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "id int, x string")


TEXTS_SQL = sql_values(list(TEXTS.items()), "doc_id, text")


def listed_sql(values: list[str | None]) -> str:
    return sql_values(list(enumerate(values)), "id, x")
