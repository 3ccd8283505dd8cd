"""Rows written once to the folder that driver and executors share, and read back from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lotwise.stored.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lotwise-")
        spark.conf.set("lotwise.stored.dir", root)
    return f"{root.rstrip('/')}/lotwise-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder: what follows reads them as often as it likes, and lost executors cost no more than
    reading again. Nothing stays in the session."""
    path = f"{folder(rows.sparkSession)}/{label}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
