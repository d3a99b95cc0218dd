"""Bottom-k sketches of word shingles as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .mixing import let

SPACE = r"[\x20\x09-\x0D]+"
FAN = 64  # bounds are searched in two steps of so many


@dataclass(frozen=True)
class SketchRule:
    """Words of a shingle, hashes kept, documents of a chunk, most chunks."""

    words: int = 5
    k: int = 128
    chunk: int = 1000
    most_chunks: int = FAN * FAN


def shingles(text: Column, words: int) -> Column:
    """Distinct 64-bit shingle hashes; a shorter text is one shingle, an empty or null one none."""
    tokens = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")

    def hashes(h):
        rolled = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[h[i + j] for j in range(words)]))
        return F.when(F.size(h) >= words, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), hashes)


def sketch(text: Column, rule: SketchRule = SketchRule()) -> Column:
    """The ``k`` least shingle hashes, ascending."""
    return F.slice(F.array_distinct(F.sort_array(shingles(text, rule.words))), 1, rule.k)


def merged(a: Column, b: Column, k: int) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that lies in both; 1 for two empty texts."""

    def share(u):
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))

    return let(merged(a, b, k), share)


def distinct_count(a: Column, k: int) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the k-th least hash."""
    kth = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _chunk_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the id; null ids come first."""
    longs = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<bigint>")
    coarse = longs(bounds[FAN - 1::FAN])
    fine = F.array(*[longs(bounds[k:k + FAN - 1]) for k in range(0, len(bounds) + 1, FAN)])
    low = lambda a: F.size(F.filter(a, lambda b: b <= doc_id))
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(let(low(coarse), lambda i: i * FAN + low(fine[i])))


def with_next(docs: DataFrame, rule: SketchRule = SketchRule()) -> tuple[DataFrame, W.WindowSpec]:
    """``doc_id, text, chunk, guest`` and the window in which the next row is the next document.

    Ids are cut into chunks at approximate quantiles, and each chunk's first
    document is also a guest at the end of the chunk before (the very first at
    the end of the last), so no window spans more than a chunk.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.count()
    parts = max(1, min(rule.most_chunks, math.ceil(total / rule.chunk)))
    bounds: list[int] = []
    if parts > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
        bounds = sorted(set(cuts or []))
    rows = rows.withColumn("chunk", _chunk_of(F.col("doc_id"), bounds))
    # One row per chunk, so at most ``most_chunks`` of them.
    firsts = [(r["chunk"], r["least"]) for r in rows.groupBy("chunk").agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id")))["doc_id"].alias("least")).orderBy("chunk").collect()]
    hosts = [(least, firsts[k - 1][0]) for k, (_, least) in enumerate(firsts)]
    guests = spark.createDataFrame(hosts, "first_id long, host int")
    places = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own, visit = F.struct("chunk", F.lit(0).alias("guest")), F.struct(F.col("host").alias("chunk"), F.lit(1).alias("guest"))
    placed = places.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("at"))
    spread = placed.select("doc_id", "text", "at.chunk", "at.guest").repartition("chunk")
    return spread, W.Window.partitionBy("chunk").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, rule: SketchRule = SketchRule()) -> DataFrame:
    """Sketches of every text, of its edited text and of the next document.

    A row per document: ``doc_id, text, edited, n_chars, own_sketch,
    edited_sketch, next_sketch``. Edited: the last half of the code points gives
    way to as many (or all) of the first of the next document by ascending id.

    Null text counts as empty and has an empty sketch. Null ids come before all
    others; rows of one id follow each other by text. After the last document
    comes the first; a lone document is its own next. Other columns are
    ignored; an empty table gives no rows.
    """
    spread, order = with_next(docs, rule)
    sketched = spread.withColumn("own_sketch", sketch(F.col("text"), rule))
    # Rows that repeat the first document's id may all be guests; the first of them is the next one.
    following = sketched.withColumn("next", F.lead(F.struct("text", "own_sketch")).over(order)).where("guest = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    return following.select("doc_id", "text", edited.alias("edited"), n.cast("long").alias("n_chars"), "own_sketch", F.col("next.own_sketch").alias("next_sketch")).withColumn(
        "edited_sketch", sketch(F.col("edited"), rule)
    )
