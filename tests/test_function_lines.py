"""Job functions are those of the SQL whatever letters and blanks a text has."""

import duckdb

import __spark_entry__ as entry
from cedrela.functions import names

TEXTS = [
    "28.68.191.238 Den ßung ßä ß geösch", "- ßte\n- ßte\n• ﬁrma ŉandú ǰabc ᾳβγ", "- " + "x" * 1500 + " fin", "Cargo: Inženýr técnico\n- Área uno\n- Ārea dos\n- Área tres", "- con espacio \n - otro\n-　tres　",
    "- uno\r\n- dos.\r\n1. tres\rcuatro\r", "- a\x0bbcd efg\n\x0b- hij\n- klm;\x85", "-    \n-\n123. no\n12) doce", "", None,
]


def test_the_rows_are_those_of_the_sql(spark, tmp_path):
    rows = [(i, x, "es", "a.org", len(x or "")) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(entry.oracle_sql()["parse_functions_documents"]).fetchall()
    got = [tuple(r) for r in entry.queries()["parse_functions_documents"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert dict((i, f) for i, _, f in got)[0] == "68.191.238 Den ẞung ßä ß Geösch"


def test_capitals_are_single_letters(spark):
    words = spark.createDataFrame([("ßung éste ŉandú ᾳβγ de " + "ñ" * 1200,)], "x string")
    assert words.select(names.title_case(words.x)).first()[0] == "ẞung Éste ŉandú ᾼβγ de Ñ" + "ñ" * 1199
