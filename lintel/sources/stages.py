"""Runs in stages: a stage's table is written once and read by later runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table that was written whole lies at a path, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def staged(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, made and written there first where it is not yet, or was not written to its end."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one in a local session."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lintel-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in any store that Spark writes."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(text.encode()))
    out.close()
