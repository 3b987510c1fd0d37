"""Shared folder and size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that the engine broadcasts at once, at most.
BROADCAST_BYTES = 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where that is unset: a temporary folder if the driver runs all tasks itself (tests), else an error, since rows
    that executors wrote to their own disks would be missing in later reads.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        at = getattr(spark, "_vecloom_scratch", None) or tempfile.mkdtemp(prefix="vecloom-")
        spark._vecloom_scratch = at
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """df written to the shared folder and read back: computed once, and there whatever executors are lost."""
    at = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def checked(size: int, what: str) -> None:
    if size > BROADCAST_BYTES:
        raise ValueError(f"{what}: {size} bytes are more than the {BROADCAST_BYTES} that may be broadcast")
