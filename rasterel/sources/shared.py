"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rasterel.scratch.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="rasterel-")
        spark.conf.set("rasterel.scratch.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
