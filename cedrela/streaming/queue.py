"""Intake of files and the queue of documents that wait, are worked on, and end as done or in error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from .ordered import SECOND, Fold

PENDING, PROCESSING, DONE, ERROR = "pending", "processing", "done", "error"


def queue(timeout: int) -> Fold:
    """An item's way through the queue: intake makes it pending, start takes it up, finish or fail end it.

    What was taken up and has neither ended in `timeout` seconds ends in error then; an end that comes later is ignored, as
    are a start of what isn't pending and an end of what isn't worked on. An item that ended is forgotten: a new intake
    queues it again. Rows: status, at (microseconds), detail.
    """

    def step(state: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        at, _, kind, detail = event
        status = state[0] if state else None
        if kind == "intake" and status is None:
            return (PENDING, at), [(PENDING, at, None)]
        if kind == "start" and status == PENDING:
            return (PROCESSING, at), [(PROCESSING, at, None)]
        if kind in ("finish", "fail") and status == PROCESSING:
            return None, [(DONE if kind == "finish" else ERROR, at, detail)]
        return state, []

    return Fold(
        event="at long, id long, event string, detail string",
        state="status string, since long",
        row="status string, at long, detail string",
        step=step,
        deadline=lambda state: state[1] + timeout * SECOND if state and state[0] == PROCESSING else None,
        expire=lambda state, at: (None, [(ERROR, at, "timeout")]),
    )


def folder(df: DataFrame, path: str, order: str, batches: int, files: int = 1) -> None:
    """Puts the rows into a folder, in `batches` times `files` files by the hash of `order`, in one job."""
    df.repartition(batches * files, order).write.mode("append").parquet(path)


def watched(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """The files of a folder as a stream, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def intake(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The documents that come into a folder (and its folders) as a stream: path, length, content, extension, method, confidence.

    Archives are opened: their members are documents by `archive!member`. An archive that can't be read is a row without
    content, so that it ends in error and not in silence.
    """
    given = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.routed(files.opened(given.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)))
