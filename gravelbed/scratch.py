"""Folders for tables and files that a query writes and reads back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir. Where it is unset a local master gets a
    folder of its own; any other master an error, as executors do not see the driver's folders."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="gravelbed-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = _OWN[0]
    return f"{root.rstrip('/')}/gravelbed/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
