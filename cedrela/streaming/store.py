"""Tables that a stream changes together: all of a batch or nothing, with partial updates and deletions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

CREATE, UPDATE, DELETE = "create", "update", "delete"


def leaves(kind: DataType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The fields of a struct that are no structs themselves, as paths."""
    if not isinstance(kind, StructType):
        return [path]
    return [leaf for f in kind.fields for leaf in leaves(f.dataType, (*path, f.name))]


def built(kind: DataType, of: Callable[[tuple[str, ...]], Column], path: tuple[str, ...] = ()) -> Column:
    """A value of this type out of its leaves."""
    if not isinstance(kind, StructType):
        return of(path)
    return F.struct(*[built(f.dataType, of, (*path, f.name)).alias(f.name) for f in kind.fields])


def alive(changes: DataFrame) -> DataFrame:
    """changes (id, seq, action, record, cleared) without those that a later create or delete of their id makes void."""
    reset = F.max(F.when(F.col("action").isin(CREATE, DELETE), F.col("seq"))).over(Window.partitionBy("id"))
    return changes.withColumn("_reset", reset).where("seq >= coalesce(_reset, seq)").drop("_reset")


def merged(changes: DataFrame) -> DataFrame:
    """id and record of what is there after the changes, whatever order they come in; seq is their order, unique by id.

    A create sets a record anew. An update overwrites the fields of the record, nested ones too, that it has (not null), and
    empties those that `cleared` names (`a.b`), whatever it has there. A delete removes it, and updates of what isn't there do nothing.
    """
    kind = changes.schema["record"].dataType
    last = alive(changes)

    def newest(path: tuple[str, ...]) -> Column:
        value = F.col("record")
        for name in path:
            value = value.getField(name)
        gone = F.coalesce(F.array_contains("cleared", ".".join(path)), F.lit(False))
        return F.max_by(F.when(~gone, value), F.when(value.isNotNull() | gone, F.col("seq")))

    named = {path: f"_f{i}" for i, path in enumerate(leaves(kind))}
    first = F.min_by("action", "seq").alias("_first")
    out = last.groupBy("id").agg(first, *[newest(path).alias(name) for path, name in named.items()]).where(F.col("_first") == CREATE)
    return out.select("id", built(kind, lambda path: F.col(named[path])).alias("record"))


class Store:
    """A folder of tables. What a batch writes is seen when its manifest is there, and that appears by one renaming.

    Data goes to files of their own first. A batch that stops half way leaves files that no manifest names; it is written
    anew when the stream goes on, and a batch whose manifest is there isn't written twice.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> str:
        return f"{self.out}/manifest/{name}.json"

    def commit(self, name: str, tables: Mapping[str, str], replaces: list[str]) -> None:
        part = self.path(f"{self.out}/manifest/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        stream.write(json.dumps({"name": name, "tables": tables, "replaces": replaces}).encode())
        stream.close()
        if not self.fs.rename(part, self.path(self._manifest(name))):
            raise OSError(f"manifest {name} of {self.out} couldn't be put in place")

    def manifests(self) -> list[dict]:
        if not self.fs.exists(self.path(f"{self.out}/manifest")):
            return []
        rows = self.spark.read.schema("name string, tables map<string,string>, replaces array<string>").json(f"{self.out}/manifest").collect()
        gone = {x for r in rows for x in r["replaces"]}
        return [r.asDict() for r in rows if r["name"] not in gone]

    def save(self, batch: DataFrame, number: int, tables: Mapping[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Writes what each table takes of a batch, all or nothing."""
        name = f"batch-{number}"
        if self.fs.exists(self.path(self._manifest(name))):
            return
        kept = batch.persist()
        paths = {}
        try:
            for table, of in tables.items():
                paths[table] = f"{self.out}/data/{table}/{name}-{uuid.uuid4().hex}"
                of(kept).write.parquet(paths[table])
        finally:
            kept.unpersist()
        self.commit(name, paths, [])

    def changes(self, table: str) -> DataFrame | None:
        """All rows of a table's files that count; None if there are none."""
        paths = [m["tables"][table] for m in self.manifests() if table in m["tables"]]
        return self.spark.read.parquet(*paths) if paths else None

    def compact(self, tables: Mapping[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Writes each table's files as one set, less what its function (alive(), say) leaves out. Tombstones must stay, so
        that an older change can't bring a record back."""
        before = self.manifests()
        paths = {}
        for table in {t for m in before for t in m["tables"]}:
            rows = self.spark.read.parquet(*[m["tables"][table] for m in before if table in m["tables"]])
            paths[table] = f"{self.out}/data/{table}/compact-{uuid.uuid4().hex}"
            tables.get(table, lambda x: x)(rows).write.parquet(paths[table])
        # What the replaced manifests replaced must stay out, too.
        gone = [r["name"] for r in self.spark.read.schema("name string").json(f"{self.out}/manifest").collect()]
        self.commit(f"compact-{uuid.uuid4().hex}", paths, gone)


def save_batches(stream: DataFrame, tables: Mapping[str, Callable[[DataFrame], DataFrame]], store: Store, checkpoint: str) -> None:
    """Works off what is there; each micro-batch changes all tables together."""
    query = stream.writeStream.foreachBatch(lambda batch, number: store.save(batch, number, tables)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
