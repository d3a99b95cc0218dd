"""Hard negatives of anchors by Fagin's threshold algorithm over blocks of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: What a block is found by.
PLACE = ["dim", "kind", "part"]


@dataclass(frozen=True)
class MineRule:
    """Anchors are ids divisible by ``every``; a negative has at least ``num / den`` of the positive's score and no more than all of it.

    Components are multiplied by ``scale`` and rounded down; beyond ``limit`` either
    way they stay there, so that scores of up to 2^16 components fit 64 bits.
    """

    every: int = 100
    positives: int = 5
    negatives: int = 5
    num: int = 80
    den: int = 100
    scale: int = 256
    limit: int = 1 << 22
    cells: int = 1 << 18  # numbers of a block
    kinds: int = 64  # labels are dealt to so many kinds; a block holds one kind
    first: int = 16  # depth of the first sorted access, four times more each time


class Lists:
    """A block of candidates: their vectors, and for every dimension their order."""

    def __init__(self, ids: bytes, labels: bytes, values: bytes, orders: bytes, dim: int, rule: MineRule):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.known = np.frombuffer(orders, np.uint8).view(bool)[: len(self.ids)]
        n = len(self.ids)
        self.rule, self.n, self.dim = rule, n, dim
        x = unpack(values, n, dim)
        self.top = int(np.abs(x).max(initial=0))
        self.x = x
        self.orders = np.frombuffer(orders, np.int32, offset=pad(n)).reshape(dim, n)  # ascending

    def exact(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sides as doubles where every inner product is a whole number below 2^53, else as 64-bit integers."""
        if self.top * int(np.abs(anchors).max(initial=0)) * max(1, self.dim) < 1 << 53:
            return anchors.astype(np.float64), self.x.astype(np.float64)
        return anchors.astype(np.int64), self.x.astype(np.int64)

    def search(self, anchor: np.ndarray, x: np.ndarray, done) -> tuple[np.ndarray, np.ndarray]:
        """Candidates met by sorted access in the anchor's direction, with their scores, once ``done`` says that no other one counts.

        ``done(at, scores, threshold)`` sees all candidates met so far; every
        candidate not met scores at most ``threshold``.
        """
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(self.n, bool)
        at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, self.rule.first
        while len(at) < self.n:
            end = min(depth + step, self.n)
            met = np.zeros(self.n, bool)
            met[self.orders[up, self.n - end : self.n - depth].ravel()] = True
            met[self.orders[down, depth:end].ravel()] = True
            if not len(up) and not len(down) or end == self.n:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            at = np.concatenate([at, new])
            scores = np.concatenate([scores, (x[new] @ anchor).astype(np.int64)])
            threshold = int(anchor[up] @ x[self.orders[up, self.n - end], up] + anchor[down] @ x[self.orders[down, end - 1], down])
            if done(at, scores, threshold):
                break
            depth, step = end, step * 4
        return at, scores


def pad(n: int) -> int:
    return (n + 3) // 4 * 4


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, else in four."""
    return values.astype(np.int16 if np.abs(values).max(initial=0) < 1 << 15 else np.int32).tobytes()


def unpack(values: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(values, np.int16 if len(values) == 2 * n * dim else np.int32).reshape(n, dim)


def leading(scores: np.ndarray, k: int) -> int | None:
    """The ``k``-th best score, None if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else None


def best(at: np.ndarray, scores: np.ndarray, lists: Lists, k: int) -> np.ndarray:
    """The first ``k`` of some candidates: higher scores first, equal scores by ascending id, null ids last."""
    if len(at) > k:
        bar = leading(scores, k)
        at, scores = at[scores >= bar], scores[scores >= bar]
    order = np.lexsort((lists.ids[at], ~lists.known[at], -scores))[:k]
    return np.stack([at[order], scores[order]], axis=1)


def near_positives(lists: Lists, vectors, labels, own, rule: MineRule) -> Iterator[tuple[int, np.ndarray]]:
    """For every anchor the block's best candidates of its label; ``own`` is its own place in the block, or -1."""
    anchors, x = lists.exact(vectors)
    for i, anchor in enumerate(anchors):
        good = lists.labels == labels[i]
        if own[i] >= 0:
            good[own[i]] = False
        due = min(rule.positives, int(good.sum()))
        if not due:
            continue

        def done(at, scores, threshold):
            bar = leading(scores[good[at]], due)
            return bar is not None and threshold < bar

        at, scores = lists.search(anchor, x, done)
        keep = good[at]
        yield i, best(at[keep], scores[keep], lists, rule.positives)


def near_negatives(lists: Lists, vectors, labels, bars: list[list[int]], rule: MineRule) -> Iterator[tuple[int, int, np.ndarray]]:
    """For every anchor and window (below a positive's score) the block's best candidates of another label."""
    anchors, x = lists.exact(vectors)
    for i, anchor in enumerate(anchors):
        good = lists.labels != labels[i]
        windows = [(-(-rule.num * p // rule.den), p) for p in bars[i]]
        if not good.any():
            continue

        def done(at, scores, threshold):
            of = scores[good[at]]
            for low, high in windows:
                if threshold >= low:
                    bar = leading(of[(of >= low) & (of <= high)], rule.negatives)
                    if bar is None or threshold >= bar:
                        return False
            return True

        at, scores = lists.search(anchor, x, done)
        at, scores = at[good[at]], scores[good[at]]
        for low, high in windows:
            keep = (scores >= low) & (scores <= high)
            if keep.any():
                yield i, high, best(at[keep], scores[keep], lists, rule.negatives)


def whole_numbers(vectors: DataFrame, rule: MineRule) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part."""
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    edge = F.lit(float(rule.limit))
    x = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * rule.scale, edge), -edge)).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", "label", x.alias("x"))


INDEX = "dim int, kind int, part int, block string, ids binary, labels binary, x binary, orders binary"
INDEX_FIELDS = pa.schema([("dim", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("block", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary()), ("orders", pa.binary())])


def blocks(rows: DataFrame, parts: DataFrame, rule: MineRule) -> DataFrame:
    """Candidates in blocks of one dimension and kind of label, each with its sorted lists."""
    part = F.pmod(F.xxhash64("vec_id", "x"), F.col("parts")).cast("int")
    dealt = rows.join(parts, ["dim", "kind"]).select("dim", "kind", part.alias("part"), "vec_id", "label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, count = [], None, 0

        def made():
            dim = key[0]
            table = pa.Table.from_batches(held)
            ids = table.column("vec_id").combine_chunks()
            n = len(ids)
            x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(n, dim)
            known = np.zeros(pad(n), bool)
            known[:n] = np.asarray(ids.is_valid())
            orders = known.tobytes() + np.argsort(x.T, axis=1, kind="stable").astype(np.int32).tobytes()
            row = [*key, "/".join(map(str, (*key, count))), np.asarray(ids.fill_null(0)).astype(np.int64).tobytes(), np.asarray(table.column("label")).astype(np.int64).tobytes(), pack(x), orders]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, INDEX_FIELDS)], schema=INDEX_FIELDS)

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                while low < high:
                    here = tuple(keys[low].tolist())
                    size = max(1, rule.cells // max(1, here[0]))
                    if key is not None and (key != here or sum(b.num_rows for b in held) >= size):
                        yield made()
                        count = count + 1 if key == here else 0
                        held = []
                    key = here
                    some = min(high - low, size - sum(b.num_rows for b in held))
                    held.append(batch.slice(low, some))
                    low += some
        if held:
            yield made()

    return dealt.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, INDEX)


ANCHORS = "dim int, kind int, block string, offsets array<int>, ids array<long>, labels array<long>, x binary"


def anchors_of(index: DataFrame, rule: MineRule) -> DataFrame:
    """The anchors of every block, with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, kind, block, ids, labels, x, orders in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                at = np.flatnonzero((ids % rule.every == 0) & np.frombuffer(orders, np.uint8).view(bool)[: len(ids)])
                if len(at):
                    out.append((dim, kind, block, at.tolist(), ids[at].tolist(), labels[at].tolist(), unpack(x, len(ids), dim)[at].astype(np.int32).tobytes()))
            if out:
                types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["dim", "kind", "block", "offsets", "ids", "labels", "x"])

    return index.select("dim", "kind", "block", "ids", "labels", "x", "orders").mapInArrow(run, ANCHORS)


FOUND = "block string, offset int, anchor_id long, bar long, vec_id long, score long"
FOUND_FIELDS = pa.schema([("block", pa.string()), ("offset", pa.int32()), ("anchor_id", pa.int64()), ("bar", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def searched(pairs: DataFrame, rule: MineRule) -> DataFrame:
    """The candidates that each pair of an anchor block and a candidate block yields; with ``bars`` negatives, else positives."""
    negatives = "bars" in pairs.columns
    columns = ["dim", "anchor_block", "offsets", "anchor_ids", "anchor_labels", "anchor_x", "block", "ids", "labels", "x", "orders", *(["bars"] if negatives else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ("", None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(columns)}
                if last[0] != row["block"]:
                    last = row["block"], Lists(row["ids"], row["labels"], row["x"], row["orders"], row["dim"], rule)
                lists, offsets, ids = last[1], row["offsets"], row["anchor_ids"]
                vectors = np.frombuffer(row["anchor_x"], np.int32).reshape(len(ids), row["dim"])
                labels = row["anchor_labels"]
                out = []
                if negatives:
                    bars = {b["offset"]: b["bars"] for b in row["bars"]}
                    at = [a for a, o in enumerate(offsets) if o in bars]
                    hits = near_negatives(lists, vectors[at], [labels[a] for a in at], [bars[offsets[a]] for a in at], rule)
                    hits = ((at[a], bar, found) for a, bar, found in hits)
                else:
                    own = offsets if row["anchor_block"] == row["block"] else [-1] * len(ids)
                    hits = ((a, None, found) for a, found in near_positives(lists, vectors, labels, own, rule))
                for a, bar, found in hits:
                    for place, score in found.tolist():
                        out.append((row["anchor_block"], offsets[a], ids[a], bar, int(lists.ids[place]) if lists.known[place] else None, score))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND_FIELDS)], schema=FOUND_FIELDS)

    return pairs.select(*columns).mapInArrow(run, FOUND)


def first_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(vectors: DataFrame, rule: MineRule = MineRule()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (``vec_id, label, embedding`` given).

    The rows are stored in blocks of some thousand vectors of one kind of label,
    each with one sorted list a dimension. The anchors of a block meet the
    blocks of their kind for positives, then all blocks for negatives. In a
    block sorted access runs through the lists in the direction of the anchor's
    signs, four times as deep each time; what it meets is scored in whole
    numbers, and it ends once the threshold (the score of a row that is as good
    as the current depth in every list) is strictly below the last score wanted:
    of the positives, or of every window that the threshold still reaches. The
    first of all blocks are then the first of all rows.

    Rows with a null label, a null vector or a component that is null or not
    finite take no part; components stay within ``rule.limit``. Vectors of
    different lengths have no score with each other; empty ones score 0. A null
    id is no anchor and comes last among equal scores. Every row counts by
    itself, also if its id or the whole row repeats: a repeated anchor is mined
    as often, and its copies may be its positives. Other columns are ignored; an
    empty table gives no rows. Dense random vectors make the lists run deep:
    the work then grows with anchors times rows, in blocks.
    """
    rows = whole_numbers(vectors, rule).withColumn("dim", F.size("x")).withColumn("kind", F.pmod("label", F.lit(rule.kinds)).cast("int"))
    rows, _ = store(rows, "mine-rows")
    size = F.greatest(F.lit(1), F.floor(F.lit(rule.cells) / F.greatest("dim", F.lit(1))))
    parts, _ = store(rows.groupBy("dim", "kind").agg(F.count("*").alias("n")).select("dim", "kind", F.ceil(F.col("n") / size).alias("parts")), "mine-parts")
    index, _ = store(blocks(rows, parts, rule), "mine-index")
    anchors, _ = store(anchors_of(index, rule), "mine-anchors")
    anchors = anchors.select("dim", "kind", F.col("block").alias("anchor_block"), "offsets", F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), F.col("x").alias("anchor_x"))
    every = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part")

    places = parts.select("dim", "kind", every)
    own = anchors.join(places, ["dim", "kind"]).join(index, PLACE)
    positives, _ = store(first_of(searched(own, rule), rule.positives, "block", "offset").drop("bar"), "mine-positives")

    usable = positives.where("score >= 0")
    bars = usable.groupBy("block", "offset").agg(F.collect_set("score").alias("bars"))
    bars = bars.groupBy(F.col("block").alias("anchor_block")).agg(F.collect_list(F.struct("offset", "bars")).alias("bars"))
    reach = anchors.drop("kind").join(bars, "anchor_block").join(places, "dim").join(index, PLACE)
    negatives = first_of(searched(reach, rule), rule.negatives, "block", "offset", "bar")
    chosen = negatives.select("block", "offset", F.col("bar").alias("positive_score"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    given = usable.select("block", "offset", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return given.join(chosen, ["block", "offset", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
