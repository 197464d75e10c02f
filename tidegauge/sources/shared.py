"""Tables in the folder that driver and executors share, to cut lineage where a result is used many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that was set; in tests on a local master, a temporary one."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not got.isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidegauge-"))
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
    return got.get().rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/tidegauge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
