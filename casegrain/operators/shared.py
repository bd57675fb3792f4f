"""Tables written to the folder that driver and executors share, where a plan's lineage is to be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder = ""


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this process, but on a local master only."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_folder = _own_folder or tempfile.mkdtemp(prefix="written-")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
