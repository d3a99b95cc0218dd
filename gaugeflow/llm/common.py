"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import fresh_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of a few numbers a row is sent to all executors if it has no more rows than this.
SMALL_ROWS = 1 << 20
#: Rows of a text table per Arrow batch; the engine bounds the bytes of a batch besides.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def id_fold(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def unit(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small enough for a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back and its path, for ``drop``."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def sent_if_small(df: DataFrame) -> DataFrame:
    """A stored, narrow table as the small side of a join: sent to all if counted as small, else shuffled."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that no later job reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
