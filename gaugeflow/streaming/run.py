"""Run a streaming plan over what is available and hand back its table."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.chunks import KEY
from ..operators.clean import latest_by_key
from ..operators.lineage import fresh_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RETAINED = "spark.sql.streaming.numRecentProgressUpdates"
EVERY = str(1 << 20)  # more micro-batches than a run has

#: A micro-batch reads about so much of a file source, unless the caller says otherwise.
BATCH_BYTES = 256 << 20


def file_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    if not any(k.startswith("max") for k in options):
        options["maxBytesPerTrigger"] = BATCH_BYTES
    return spark.readStream.schema(schema).options(**options).parquet(path)


#: A row of this station stands at the end of a staged table and moves the watermark past all others.
END_STATION, END_TIME = -(1 << 62), "2200-01-01 00:00:00"


def staged_stream(df: DataFrame, name: str, order: str, end: bool = False) -> DataFrame:
    """Land a batch table in the shared folder and read it as a stream, in the order of the column ``order``.

    Every file holds a range of ``order`` and equal values share a file, so each
    micro-batch goes on where the one before stopped. With ``end`` one more row,
    of a station of its own, tells operators that wait for the watermark that
    the table is complete; they never hand it on.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if end:
        last = [F.lit(END_STATION) if c == KEY else F.lit(END_TIME) if c == order else F.lit(None) for c in df.columns]
        df = df.unionByName(spark.range(1).select(*[v.cast(df.schema[c].dataType).alias(c) for v, c in zip(last, df.columns)]))
    df.repartitionByRange(order).write.parquet(path)
    _read_by_number(spark, path)
    return file_stream(spark, path, df.schema)


def _read_by_number(spark: SparkSession, path: str) -> None:
    """A file source reads files by their time: give them times in the order of their part numbers."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def parts():
        return sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: int(f.getPath().getName().split("-")[1]))

    files = parts()
    newest = min((f.getModificationTime() for f in files), default=0)
    for back, f in enumerate(reversed(files)):
        fs.setTimes(f.getPath(), newest - 1000 * back, -1)
    times = [f.getModificationTime() for f in parts()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise RuntimeError(f"the file system of {path} keeps no given file times, so its files cannot be streamed in order")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def watched(writer: DataStreamWriter, name: str, whole: bool, clock: bool = False) -> None:
    """Run a stream to its end; with ``whole`` it is an error if the engine drops a row as too late.

    A stream with timers of the ``clock`` never ends by itself: it is stopped
    after the first micro-batch that found nothing new to read.
    """
    spark = writer._spark
    retained = spark.conf.get(RETAINED)
    if whole:
        spark.conf.set(RETAINED, EVERY)
    try:
        if clock:
            running = writer.trigger(processingTime="0 seconds").start()
            while running.isActive and not any(p.batchId and not p.numInputRows for p in running.recentProgress):
                time.sleep(0.05)
            if running.exception():
                raise running.exception()
            running.stop()  # may break off an idle micro-batch
        else:
            running = writer.trigger(availableNow=True).start()
            running.awaitTermination()
        late = sum(o.numRowsDroppedByWatermark for p in running.recentProgress for o in p.stateOperators) if whole else 0
    finally:
        spark.conf.set(RETAINED, retained)
    if late:
        raise RuntimeError(f"{name}: {late} rows came after the watermark and were dropped")


def drain(stream: DataFrame, name: str, mode: str = "append", key: Sequence[str] | None = None, machine: bool = False,
          out: str | None = None, checkpoint: str | None = None, whole: bool = False, clock: bool = False) -> DataFrame:
    """Process everything available, each micro-batch landing in its own directory.

    ``out`` and ``checkpoint`` name where the table and the progress are kept: a
    later call with the same paths goes on where the last one stopped.  Without
    them both are new folders.  Rewriting the directory of a batch makes a
    replay after a failure harmless.  In update mode ``key`` keeps the newest version of each row.
    ``machine`` selects the state store that arbitrary state machines need.
    With ``whole`` it is an error if the engine drops a row as too late; ``clock``
    tells that the stream has timers of the clock.
    """
    spark = stream.sparkSession
    out, state = out or fresh_path(spark, name), checkpoint or fresh_path(spark, f"{name}-state")
    schema = stream.schema

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = spark.conf.get(PROVIDER)
    if machine:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        watched(stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(land), name, whole, clock)
    finally:
        spark.conf.set(PROVIDER, before)
    landed = spark.read.schema(schema.add("batch", "long")).option("basePath", out).parquet(f"{out}/*")
    if key:
        landed = latest_by_key(landed, list(key), [F.col("batch")])
    return landed.drop("batch")
