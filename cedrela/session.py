"""A session with what the engine relies on. Sizes follow the cluster; only behaviour is set here."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, **more: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    } | more
    builder = SparkSession.builder.appName("cedrela").config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names; where that is unset, on one machine (tests), under a
    temporary one."""
    if not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
