"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store
from .components import components

LINKS = "node long, links long, to long"
LINK_FIELDS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


@dataclass(frozen=True)
class StableRule:
    """Cosine to reach, width of a quantum, chance to find a pair just at ``cosine``, unrelated vectors a bucket may hold, rows of a block."""

    cosine: float = 0.9
    width: float = 2.0
    recall: float = 0.97
    unrelated: int = 256
    block: int = 1024
    seed: int = 5


def meet(distance: float, width: float) -> float:
    """Chance that two vectors at ``distance`` fall into the same quantum of one projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, rule: StableRule) -> tuple[int, int]:
    """Projections per table and tables: more vectors need more selective buckets, and those more tables."""
    near, far = meet(math.sqrt(2 - 2 * rule.cosine), rule.width), meet(math.sqrt(2), rule.width)
    k = max(2, round(math.log(max(2.0, n / rule.unrelated)) / -math.log(far)))
    return k, math.ceil(math.log(1 - rule.recall) / math.log(1 - near**k))


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bucket_codes(x: np.ndarray, k: int, tables: int, rule: StableRule) -> np.ndarray:
    """A 64-bit bucket per vector and table."""
    draw = np.random.default_rng((rule.seed, x.shape[1]))
    lines, shift = draw.standard_normal((x.shape[1], k * tables)), draw.uniform(0, rule.width, k * tables)
    cells = np.floor((x @ lines + shift) / rule.width).astype(np.int64).reshape(len(x), tables, k)
    odd = draw.integers(1 << 62, size=k) * 2 + 1
    mixed = (cells * odd).sum(axis=2) + (np.arange(tables) * 1_000_003 + x.shape[1])[None, :] * 0x5851F42D4C957F2D
    return mixed ^ (mixed >> 29)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    labels = np.arange(len(linked))
    while True:
        near = np.where(linked, labels[None, :], len(linked)).min(axis=1)
        new = np.minimum(labels, near)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def compare(nodes, copies, x, codes, table: int, first: np.ndarray, within: bool, rule: StableRule):
    """Links of a bucket, or between two of its blocks (``first`` marks the rows of the one), not met in an earlier table."""
    linked = x @ x.T >= rule.cosine
    for t in range(table):
        linked &= codes[:, t, None] != codes[None, :, t]
    np.fill_diagonal(linked, False)
    if not within:
        linked &= first[:, None] != first[None, :]
    links = (linked * copies[None, :]).sum(axis=1)
    labels = least_labels(linked)
    at = np.flatnonzero(links)
    return nodes[at], links[at], nodes[labels[at]]


def near_duplicates(vectors: DataFrame, rule: StableRule = StableRule()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Equal vectors are one node with a number of copies. Nodes are bucketed by
    quantised projections in several tables; within a bucket all cosines are
    computed in double precision, and a pair counts in the first table where it
    meets. Only counts and spanning links leave a task. A bucket of more than
    ``rule.block`` nodes is cut into blocks, and pairs of blocks are tasks.

    Vectors that are null, empty, zero, or hold a null or a number that is not
    finite, and rows without an id, link with nothing: they are their own
    component and kept. Vectors of different lengths never link. Ids may repeat;
    ``kept`` is ``vec_id = component_id``. Other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    width = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    value = F.col("embedding") if width == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), value.alias("embedding"))
    good = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    )
    ids, _ = store(
        rows.select("vec_id", F.when(good, F.xxhash64("embedding", F.lit(rule.seed))).alias("node"), F.when(good, F.col("embedding")).alias("embedding")), "vec-rows"
    )
    nodes, _ = store(
        ids.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("embedding").alias("embedding")), "vec-nodes"
    )
    k, tables = shape(nodes.count(), rule)
    code_fields = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("codes", pa.list_(pa.int64()))])

    def hashed(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = np.asarray(lists.value_lengths())
            flat, starts = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = flat[starts[at][:, None] + np.arange(d)[None, :]].astype(width)
                codes = bucket_codes(normalised(x), k, tables, rule)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))], schema=code_fields
                )

    coded = nodes.select("node", "copies", "embedding").mapInArrow(hashed, "node long, copies long, vector binary, codes array<long>")
    placed = coded.select("node", "copies", "vector", "codes", F.posexplode("codes").alias("table", "bucket"))
    # Only buckets with company are compared; large ones are cut into blocks.
    sizes, _ = store(placed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "vec-buckets")
    blocks = F.ceil(F.col("n") / F.lit(rule.block)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(rule.seed + 1)), F.col("blocks")).cast("int")
    cut = placed.join(sizes.select("table", "bucket", blocks.alias("blocks")), ["table", "bucket"]).withColumn("own", own)
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "table", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "copies", "vector", "codes"
    )
    keys = ["table", "bucket", "low", "high"]

    def linked(batches):
        held: list[tuple] = []
        out: list[tuple] = []

        def finish():
            if len(held) > 1:
                table, _, low, high = held[0][0]
                sizes_ = {}
                for r in held:
                    sizes_.setdefault(len(r[4]), []).append(r)
                for same in sizes_.values():  # one length unless hashes collide
                    x = normalised(np.frombuffer(b"".join(r[4] for r in same), dtype=width).reshape(len(same), -1))
                    out.append(compare(
                        np.array([r[2] for r in same]), np.array([r[3] for r in same]), x, np.array([r[5] for r in same]).reshape(len(same), -1)[:, :table], table,
                        np.array([r[1] == low for r in same]), low == high, rule,
                    ))
            held.clear()

        for batch in batches:
            columns = [batch.column(j).to_pylist() for j in range(5)]
            own_, node_, copies_, vector_, codes_ = columns[4], *(batch.column(j).to_pylist() for j in range(5, 8)), batch.column(8)
            for r, key in enumerate(zip(*columns[:4])):
                if held and held[0][0] != key:
                    finish()
                held.append((key, own_[r], node_[r], copies_[r], vector_[r], codes_[r].values.to_numpy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], schema=LINK_FIELDS)
                out.clear()
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], schema=LINK_FIELDS)

    links, _ = store(spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, LINKS), "vec-links")
    labels = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.select("node", "copies", "least_id").join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = facts.groupBy("label").agg(F.min("least_id").alias("component_id"))
    known = facts.join(heads, "label").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    joined = ids.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
