"""Stored tables that are found by a key, or by a second one, without reading the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table, and requests that are sent to every task at most (more are shuffled).
SLOTS, FEW = 64, 1_000_000


class Tables:
    """Tables in a folder, each in parts by the hash of its key and in order of the key within a file.

    A second key has a table of its own that leads to the first, so both ways read only the parts that the requests fall
    into; within a file, statistics and Parquet's Bloom filters rule out row groups. Rows without the first key are stored by
    the second. A part with a hot key is written as several files.
    """

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots
        self.keys: dict[str, tuple[str, str]] = {}

    def slot(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def _write(self, df: DataFrame, name: str, key: str, blooms: list[str]) -> None:
        writer = df.withColumn("slot", self.slot(key)).hint("rebalance", "slot").sortWithinPartitions("slot", key).write.mode("overwrite").partitionBy("slot")
        for column in blooms:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", "100000")
        writer.parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame, key: str, second: str) -> None:
        """Stores a table that is found by `key`, or by `second`. Rows that have neither are found by no key."""
        self.keys[name] = key, second
        self._write(df.where(F.col(key).isNotNull()), name, key, [key, second])
        self._write(df.where(F.col(key).isNull()), f"{name}_without_{key}", second, [second])
        self._write(df.where(F.col(key).isNotNull() & F.col(second).isNotNull()).select(second, key).distinct(), f"{name}_by_{second}", second, [second])

    def rows(self, name: str) -> DataFrame:
        """The whole table."""
        return self._read(name).unionByName(self._read(f"{name}_without_{self.keys[name][0]}")).drop("slot")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _found(self, name: str, key: str, keys: DataFrame) -> DataFrame:
        """Rows of a stored table whose key is among `keys` (distinct, column `key`). Parts are chosen by the requests' slots:
        at most `slots` numbers, which come to the driver."""
        asked = keys.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_slot", self.slot(key))
        sizes = {r["_slot"]: r["count"] for r in asked.groupBy("_slot").count().collect()}
        rows = self._read(name).where(F.col("slot").isin(sorted(sizes))).drop("slot")
        asked = asked.drop("_slot")
        return rows.join(F.broadcast(asked) if sum(sizes.values()) <= FEW else asked, key, "left_semi")

    def by_key(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the table whose key is in the column of that name."""
        return self._found(name, self.keys[name][0], keys)

    def by_second(self, name: str, values: DataFrame) -> DataFrame:
        """Rows of the table whose second key is in the column of that name, through the second key's table."""
        key, second = self.keys[name]
        led = self.by_key(name, self._found(f"{name}_by_{second}", second, values).select(key))
        wanted = values.where(F.col(second).isNotNull()).select(second).distinct()
        return led.join(wanted, second, "left_semi").unionByName(self._found(f"{name}_without_{key}", second, values))

    def lookup(self, name: str, requests: DataFrame) -> DataFrame:
        """requests (with columns called like both keys) joined with what the table has for them: by the first key where the
        request has one, else by the second, else nothing. The table's columns come as a struct `found`."""
        key, second = self.keys[name]
        packed = lambda rows, on: rows.select(F.col(on), F.struct(*[F.col(c) for c in rows.columns]).alias("found"))
        first, other = requests.where(F.col(key).isNotNull()), requests.where(F.col(key).isNull() & F.col(second).isNotNull())
        by_first = first.join(packed(self.by_key(name, first), key), key)
        return by_first.unionByName(other.join(packed(self.by_second(name, other), second), second))
