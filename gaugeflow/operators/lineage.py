"""Materialise an intermediate table so that later branches do not recompute it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for intermediate tables.

    Without that setting a session on one machine gets a temporary folder; on a
    cluster executors would each write to their own disk, so that is an error.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeflow-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches need the same reduced table (an aggregate or a
    sparse set of marks).  Being a stored table it survives lost executors,
    and readers still prune columns and push filters.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
