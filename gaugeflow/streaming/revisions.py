"""Revision detection between consecutive forecast issues of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import KEY
from ..operators.lineage import fresh_path
from ..operators.revision import compare_issues
from ..policy import RevisionPolicy


def watch(hourly: DataFrame, name: str = "revisions", policy: RevisionPolicy = RevisionPolicy(), folder: str | None = None) -> DataFrame:
    """Compare each arriving issue with the station's previous one; returns the landed table.

    Every micro-batch runs the batch comparison over its issues plus the
    newest earlier issue of each station, which the previous batch left in the
    shared folder.  Directories are named by batch, so replays overwrite.
    ``folder`` keeps table and progress: a later call with it goes on where the
    last one stopped.
    """
    spark = hourly.sparkSession
    folder = folder or fresh_path(spark, name)
    out, last, state = (f"{folder}/{s}" for s in ("table", "last", "state"))
    columns = [KEY, "issued_hour", "valid_at", "temp", "rain_prob"]
    schema = hourly.select(*columns).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns)
        known = rows.withColumn("_old", F.lit(False))
        if batch_id > 0:
            old = spark.read.schema(schema).parquet(f"{last}/batch={batch_id - 1}")
            known = known.unionByName(old.withColumn("_old", F.lit(True)))
        issues = known.select(KEY, "issued_hour", "_old").distinct()
        revisions = compare_issues(known.drop("_old"), policy)
        fresh = revisions.join(issues.filter("not _old").drop("_old"), [KEY, "issued_hour"], "left_semi")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        newest = known.groupBy(KEY).agg(F.max("issued_hour").alias("issued_hour"))
        known.drop("_old").join(newest, [KEY, "issued_hour"], "left_semi").write.mode("overwrite").parquet(f"{last}/batch={batch_id}")

    run = (
        hourly.writeStream.option("checkpointLocation", state).foreachBatch(step).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/*").drop("batch")
