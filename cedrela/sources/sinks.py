"""Rows to files and to the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_rows(df: DataFrame) -> DataFrame:
    """Snake-case names; lists and records become JSON text; null stays."""
    import re

    nested = (T.ArrayType, T.StructType, T.MapType)
    name = lambda c: re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c).lower()
    return df.select(*[(F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name)).alias(name(f.name)) for f in df.schema])


def write_index(df: DataFrame, path: str) -> None:
    """A semicolon CSV, quoted where needed, and a JSON copy."""
    df.write.mode("overwrite").option("sep", ";").option("header", "true").option("escape", '"').csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def change_log(df: DataFrame, action: str, table: str, key: str) -> DataFrame:
    """seq, action, table_name, record_id, payload, synced of rows to replay elsewhere; seq orders them by key."""
    payload = F.to_json(F.struct(*df.columns))
    return df.select(F.xxhash64(key, F.lit(action)).alias("seq"), F.lit(action).alias("action"), F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"), payload.alias("payload"), F.lit(0).alias("synced"))


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
