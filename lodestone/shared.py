"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of spark.checkpoint.dir.

    Where that is unset, a temporary folder is made on a local master only: on a cluster the
    executors could not see it.
    """
    context = spark.sparkContext
    home = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not home:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = tempfile.mkdtemp(prefix="lodestone-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(home)
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written once to the shared folder, so that numbers given to its rows stay theirs however often it is read. The files go when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
