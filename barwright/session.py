"""A session with the settings the operators count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "barwright", **settings: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; any setting may be overridden (underscores for dots)."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors see; a temporary one where none is named and there is one machine only."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder and not context.getCheckpointDir() and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barwright-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """A frame written once to the shared folder and read again: plans on it begin at its files, not at what it was made from."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
