"""Readings stored once each, however late and however often they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chunks import KEY
from ..operators.clean import latest_by_key
from .run import children, remove

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
#: Columns that tell when a row of a file source arrived.
ARRIVAL = ("_file_time", "_file", "_row")


def arrivals(files: DataFrame) -> DataFrame:
    """The rows of a file stream with the time and name of their file and their place in it."""
    meta = ("file_modification_time", "file_path", "row_index")
    return files.select("*", *[F.col(f"_metadata.{m}").alias(a) for m, a in zip(meta, ARRIVAL)])


class KeyStore:
    """The (station, time) pairs stored so far: one bucketed folder a date, rewritten when the date gets new ones.

    The table is bucketed by both columns, so that a join on them reads its
    files in place and shuffles only the other side, and a station with most of
    the rows lies in all buckets. Every micro-batch writes a new version of the
    dates it adds to and the one before it stays for a replay, so a date is
    always read from one version, whatever the number of micro-batches.
    """

    def __init__(self, spark: SparkSession, folder: str, ts: str, buckets: int):
        self.spark, self.path, self.ts = spark, f"{folder}/keys", ts
        self.name = "keys_" + "".join(c if c.isalnum() else "_" for c in folder)[-100:]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` ({KEY} BIGINT, `{ts}` TIMESTAMP, date STRING, version BIGINT) USING parquet "
            f"PARTITIONED BY (date, version) CLUSTERED BY ({KEY}, `{ts}`) SORTED BY ({KEY}, `{ts}`) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def known(self, dates: Sequence[str], batch_id: int) -> DataFrame:
        """The keys of some dates as the batches before left them; outdated versions are removed."""
        for date in dates:
            for old in self._versions(date, batch_id)[:-1]:
                remove(self.spark, f"{self.path}/date={date}/version={old}")
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).filter(F.col("date").isin(list(dates)) & (F.col("version") < batch_id)).select(KEY, self.ts)

    def _versions(self, date: str, batch_id: int) -> list[int]:
        """Versions of a date from before a batch, in their order."""
        found = (int(p.split("=")[1]) for p in children(self.spark, f"{self.path}/date={date}"))
        return sorted(v for v in found if v < batch_id)

    def add(self, fresh: DataFrame, batch_id: int) -> None:
        """Write new versions of the dates of ``fresh`` (stored rows); a replay writes the same folders again."""
        dates = [r["date"] for r in fresh.select("date").distinct().collect()]
        before = [f"{self.path}/date={d}/version={v}" for d in dates for v in self._versions(d, batch_id)[-1:]]
        rows = fresh.select(KEY, self.ts, "date")
        if before:
            kind = f"{KEY} long, `{self.ts}` timestamp, date string, version long"
            rows = rows.unionByName(self.spark.read.schema(kind).option("basePath", self.path).parquet(*before).select(*rows.columns))
        if not dates:
            return
        rows = rows.select(KEY, self.ts, "date", F.lit(batch_id).cast("long").alias("version"))
        mode = self.spark.conf.get(OVERWRITE)
        self.spark.conf.set(OVERWRITE, "dynamic")  # a table's writer takes it from the session alone
        try:
            rows.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(OVERWRITE, mode)


def store_unique(stream: DataFrame, out: str, checkpoint: str, ts: str = "ts", arrival: Sequence[str] = (), buckets: int = 16) -> DataFrame:
    """Store the first arrival of each (station, time) however late it comes; returns the stored table.

    No state and no watermark: a micro-batch is compared with the keys stored
    for its dates. ``arrival`` names the columns that order arrivals within a
    micro-batch (see ``arrivals``; they are not stored); without them the order
    of its rows counts. ``out`` holds the rows by date and micro-batch and the
    keys by date; what a batch reads grows with its dates, not with the batches
    before it. A replay after a failure writes the same folders again. Rows
    without station or time are an error.
    """
    spark = stream.sparkSession
    stored = [f for f in stream.schema.fields if f.name not in arrival]
    names = [f.name for f in stored]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored) + ", date string, batch long"
    keys = KeyStore(spark, out, ts, buckets)

    def land(batch: DataFrame, batch_id: int) -> None:
        missing = F.col(KEY).isNull() | F.col(ts).isNull()
        day = F.when(missing, F.raise_error(F.lit("a row lacks its station or time")).cast("string")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
        numbered = batch.withColumn("date", day).withColumn("_number", F.monotonically_increasing_id())
        order = Window.partitionBy(KEY, ts).orderBy(*arrival, "_number")
        rows = numbered.withColumn("_i", F.row_number().over(order)).filter("_i = 1").select(*names, "date").persist()
        dates = [r["date"] for r in rows.select("date").distinct().collect()]
        known = keys.known(dates, batch_id)
        # Dealt as the stored keys are, so that these are read in place.
        fresh = rows.repartition(buckets, KEY, ts).join(known, [KEY, ts], "left_anti")
        fresh.write.mode("overwrite").partitionBy("date").parquet(f"{out}/rows/batch={batch_id}")
        keys.add(spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch={batch_id}"), batch_id)
        rows.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*").select(*names)


#: Folder levels of a table; no columns of its own.
BUCKET, VERSION = "in_bucket", "as_of_batch"


class Table:
    """A table kept by key while streams write it: buckets of rows, and manifests that tell which version of each bucket counts.

    Only the buckets of the keys at hand are rewritten, as a folder named by the
    micro-batch; the manifest of a micro-batch is written last, so a reader sees
    all of a micro-batch or nothing. Folders that neither the newest manifest
    nor the one before names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder, self.kind = spark, folder, kind

    def _manifest(self, before: int | None = None) -> tuple[int, dict[int, int]]:
        """The newest manifest (before a micro-batch): its number and the version of every bucket."""
        known = sorted(int(p.split("=")[1]) for p in children(self.spark, f"{self.folder}/manifests"))
        known = [k for k in known if (before is None or k < before) and "_SUCCESS" in children(self.spark, f"{self.folder}/manifests/batch={k}")]
        if not known:
            return -1, {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/manifests/batch={known[-1]}").collect()
        return known[-1], {r["bucket"]: r["version"] for r in rows}

    def read(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows as the last whole micro-batch left them."""
        _, versions = self._manifest(before)
        paths = [f"{self.folder}/rows/{BUCKET}={b}/{VERSION}={v}" for b, v in versions.items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.kind)
        return self.spark.read.schema(self.kind).parquet(*paths)

    def write(self, rows: DataFrame, buckets: Sequence[int], batch_id: int) -> None:
        """``rows`` (with their bucket) are all rows of ``buckets``."""
        last, versions = self._manifest(batch_id)
        rows.withColumn(VERSION, F.lit(batch_id).cast("long")).repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(f"{self.folder}/rows")
        now = versions | {b: batch_id for b in buckets}
        self.spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/batch={batch_id}")
        for b in buckets:
            for old in children(self.spark, f"{self.folder}/rows/{BUCKET}={b}"):
                if int(old.split("=")[1]) < versions.get(b, 0):
                    remove(self.spark, f"{self.folder}/rows/{BUCKET}={b}/{old}")
        for old in children(self.spark, f"{self.folder}/manifests"):
            if int(old.split("=")[1]) < last:
                remove(self.spark, f"{self.folder}/manifests/{old}")


def keep_latest(stream: DataFrame, key: Sequence[str], version: str, folder: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Keep one row per ``key``, that of the greatest ``version`` ever seen; returns the table.

    A writer that is behind (an older version arriving late) changes nothing, nor
    does a replay. Equal versions of a key are expected to be equal rows. Rows
    without a version lose to any other. ``Table(spark, folder, kind).read()``
    reads the table while the stream runs.
    """
    spark, names = stream.sparkSession, stream.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    table = Table(spark, folder, kind)

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = latest_by_key(batch, list(key), [F.col(version)]).withColumn(BUCKET, F.pmod(F.hash(*key), F.lit(buckets))).persist()
        touched = sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())
        if touched:
            past = table.read(batch_id, touched).withColumn(BUCKET, F.pmod(F.hash(*key), F.lit(buckets)))
            both = latest_by_key(rows.unionByName(past), [*key, BUCKET], [F.col(version)])
            table.write(both.select(*names, BUCKET), touched, batch_id)
        rows.unpersist()

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land).trigger(availableNow=True).start().awaitTermination()
    return table.read()
