"""Tables between two steps of one operator, in the folder that driver and
executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on a single machine, where that is unset,
    a folder below the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path, not yet made."""
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: what follows sees one and the same rows,
    and a lost executor costs a re-read."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
