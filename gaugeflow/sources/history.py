"""Reading history on files: CSV scans of mixed versions, date-partitioned sinks, backfill."""

from __future__ import annotations

import csv
import datetime
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import KEY
from ..operators.clean import CORE_COLUMNS, coerce, insert_ignore, latest_by_key, with_missing
from ..operators.features import OPTIONAL_DEFAULTS

OPTIONAL_COLUMNS = (*OPTIONAL_DEFAULTS, "light")


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a CSV file, compressed or not; none of an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    opened = target.getFileSystem(conf).open(target)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(target)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(opened) if codec else opened, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line else ()


def header_groups(spark: SparkSession, folder: str, pattern: str = "*.csv*", threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder and its subfolders by their header; empty files have none.

    One short read a file, some at a time; the lines themselves stay where they are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path").collect()
    paths = sorted(r["path"] for r in files)
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(threads) as pool:
        for path, header in zip(paths, pool.map(lambda p: header_of(spark, p), paths)):
            if header:
                found.setdefault(header, []).append(path)
    return found


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.csv*", key: Sequence[str] | None = None) -> DataFrame:
    """A folder of CSV histories of any versions: files of one header are one scan, united by name (see ``scan_csv``).

    Of equal keys the row of the file with the greatest path is kept.
    """
    groups = header_groups(spark, folder, pattern)
    if not groups:
        raise FileNotFoundError(f"no CSV file with a header in {folder}")
    return scan_csv(spark, list(groups.values()), key)


def scan_csv(spark: SparkSession, groups: Sequence[str | Sequence[str]], key: Sequence[str] | None = None) -> DataFrame:
    """Read CSV histories; each group holds files with the same header.

    Groups differ in columns (the format grew over time) and are united by
    name.  Values are coerced, repeated header lines and rows without core
    values dropped, and of equal keys the later file's row kept. Unless ``key``
    is given it is the timestamp, with the station if any file names one.
    """
    frames = [
        spark.read.option("header", True).csv(g if isinstance(g, str) else list(g)).withColumn("_file", F.input_file_name())
        for g in groups
    ]
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    key = key or [c for c in (KEY, "timestamp") if c in df.columns]
    df = coerce(df, [*CORE_COLUMNS, *OPTIONAL_COLUMNS])
    df = df.withColumn("_line", F.monotonically_increasing_id())
    return with_missing(latest_by_key(df, list(key), [F.col("_file"), F.col("_line")]).drop("_file", "_line"), OPTIONAL_COLUMNS)


def newest_days(df: DataFrame, k: int = 2, date: str = "date") -> DataFrame:
    """Rows of the newest ``k`` date partitions.

    The dates come from the directory names, so the scan is pruned by literals
    and nothing else is read; a table without such directories is asked for its
    dates first.
    """
    found = {m[1] for f in df.inputFiles() if (m := re.search(rf"/{re.escape(date)}=(\d{{4}}-\d\d-\d\d)/", f))}
    if not found:
        found = {str(r[0]) for r in df.select(date).distinct().orderBy(F.col(date).desc()).limit(k).collect()}
    return df.filter(F.col(date).isin([datetime.date.fromisoformat(d) for d in sorted(found)[-k:]]))


def balanced(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a partition value together, in tasks of about the advisory size of adaptive execution.

    Small values share a task and write one file each; a value with more bytes
    than that, such as a hot date, is split over as many tasks as it needs.
    """
    return df.hint("rebalance", *by)


def append_by_date(df: DataFrame, path: str, ts: str = "ts", fmt: str = "parquet") -> None:
    """Append readings to one directory per UTC date, in files of about the advisory size."""
    balanced(df.withColumn("date", F.to_date(ts)), "date").write.mode("append").partitionBy("date").format(fmt).save(path)


def replace_dates(df: DataFrame, path: str, ts: str = "ts", fmt: str = "parquet") -> None:
    """Replace the directories of the dates present in ``df``; others stay as they are."""
    rows = balanced(df.withColumn("date", F.to_date(ts)), "date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").format(fmt).save(path)


def backfill(existing: DataFrame, incoming: DataFrame, key: Sequence[str], arrival: str) -> DataFrame:
    """Rows of a CSV history that a table does not hold yet."""
    return insert_ignore(existing, incoming, key, arrival)


def replace_scores(scores: DataFrame, path: str) -> None:
    """Replace the score partitions of the dates present in ``scores``."""
    balanced(scores, "as_of_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(path)


def write_report(df: DataFrame, path: str, by: Sequence[str] = ("horizon",), fmt: str = "parquet") -> None:
    """Holdout, validation, reliability and sweep tables, one directory per horizon."""
    writer = balanced(df, *by).write.mode("overwrite").partitionBy(*by)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
