"""Random forests over rows of a few bits a feature: a task grows a group of trees.

Spark ML sends the statistics of every open node of every tree through a
shuffle, level by level, and looks each of them up row by row. Rows of a forest
fit a task once a feature is the number of its bin, so Spark hands the rows of
its stored table to several tasks, each of which grows some of the trees, level
by level and in whole columns. The rules are those of Spark ML: bins between
quantiles of a sample, Poisson draws of rows, features drawn for every node,
the greatest gain, both sides of at least so many draws, and leaves that
predict the same put together. Nodes come out as rows of Spark's own stored
form of a model.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows as they are stored: words with the bins of some features each, what is learned, the weight.
BINNED = "bins binary, label double, weight double"
#: Spark's stored form of a tree ensemble.
NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double,"
    " leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")
#: What a step holds at once: rows with their bins, and cells of the nodes' histograms.
STEP_ROWS, NODE_CELLS = 1 << 15, 1 << 18


@dataclass(frozen=True)
class Growth:
    classes: bool  # two classes by Gini, else values by variance
    depth: int
    min_leaf: int
    min_gain: float
    tried: int  # features a node
    bins: int
    seed: int
    draw: bool  # each tree on its own draw of the rows, with replacement
    rate: float = 1.0  # draws a row on average


def rule_of(estimator, width: int, classes: bool) -> Growth:
    """What a Spark estimator of a forest asks for."""
    trees, asked = estimator.getNumTrees(), estimator.getFeatureSubsetStrategy()
    if estimator.getMaxBins() > 256:
        raise ValueError("at most 256 bins")
    if asked == "auto":
        asked = "all" if trees == 1 else "sqrt" if classes else "onethird"
    shares = {"all": width, "sqrt": np.ceil(np.sqrt(width)), "onethird": np.ceil(width / 3.0), "log2": max(1, np.ceil(np.log2(width)))}
    return Growth(
        classes, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain(), int(shares[asked]),
        estimator.getMaxBins(), estimator.getSeed(), estimator.getBootstrap(), estimator.getSubsamplingRate())


def describe(spark: SparkSession, path: str, estimator, classes: bool, width: int) -> None:
    """What Spark's stored form of a model holds besides the nodes, so that Spark ML can load it."""
    name, trees = ("Classification" if classes else "Regression"), estimator.getNumTrees()

    def facts(kind: str, uid: str, params: dict, **more) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.{name.lower()}.{kind}{name}Model", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
            "paramMap": params, "defaultParamMap": {}, "numFeatures": width, **({"numClasses": 2} if classes else {}), **more})

    params = {p.name: v for p, v in estimator.extractParamMap().items()}
    spark.createDataFrame([(facts("RandomForest", estimator.uid, params, numTrees=trees),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, facts("DecisionTree", f"{estimator.uid}_{i}", {}), 1.0) for i in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")


# ---- bins --------------------------------------------------------------------------------
def split_points(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` thresholds, midway between values, so that bins hold about equal weight."""
    distinct, place = np.unique(values, return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) < bins:
        return middles
    upto = np.cumsum(np.bincount(place, weights))
    stride, at, out = upto[-1] / bins, -1, []
    both = upto[:-1] + upto[1:]
    for k in range(1, bins):
        at = max(at + 1, int(np.searchsorted(both, 2.0 * stride * k, "right")))
        if at >= len(middles):
            break
        out.append(middles[at])
    return np.array(out)


def sampled(rows: DataFrame, n: int, bins: int, seed: int) -> DataFrame:
    """As many of ``n`` rows as Spark ML looks at for thresholds."""
    wanted = max(bins * bins, 10_000)
    return rows if n <= wanted else rows.sample(wanted / n, seed)


def split_points_of(sample: DataFrame, bins: int) -> list[np.ndarray]:
    """Thresholds of every feature (``sample``: values, label, weight)."""
    table = sample.select("values", "weight").toArrow()
    if not table.num_rows:
        raise ValueError("a forest needs rows")
    weights = table["weight"].to_numpy()
    values = table["values"].combine_chunks().flatten().to_numpy().reshape(len(weights), -1)
    return [split_points(v, weights, bins) for v in values.T]


def stored_features(points: Sequence[np.ndarray]) -> np.ndarray:
    """The features that tell rows apart, at least one."""
    return np.flatnonzero([len(p) > 0 for p in points] if any(map(len, points)) else [True])


class Packing:
    """Where the bin of a stored feature lies: several in a word of 63 bits (12 of 32 bins)."""

    def __init__(self, points: Sequence[np.ndarray], bins: int):
        self.stored = stored_features(points)
        self.bits = max(1, int(bins - 1).bit_length())
        self.mask, each = (1 << self.bits) - 1, 63 // self.bits
        self.words = -(-len(self.stored) // each)
        self.word, self.shift = np.zeros(len(points), np.intp), np.zeros(len(points), np.intp)
        self.word[self.stored], self.shift[self.stored] = np.divmod(np.arange(len(self.stored)), each)
        self.shift *= self.bits


def binned(rows: DataFrame, points: Sequence[np.ndarray], bins: int) -> DataFrame:
    """The bin of every value, as many thresholds as lie below it, of the stored features."""
    pack = Packing(points, bins)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b["values"].flatten().to_numpy().reshape(b.num_rows, len(points))
            words = np.zeros((b.num_rows, pack.words), np.int64)
            for f in pack.stored:
                words[:, pack.word[f]] |= np.searchsorted(points[f], values[:, f]) << pack.shift[f]
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * pack.words), b.num_rows, [None, pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), b["label"], b["weight"]], ["bins", "label", "weight"])

    return rows.mapInArrow(of_batches, BINNED)


def as_values(rows: DataFrame, features: str, label: str, weight: str | None) -> DataFrame:
    return rows.select(
        vector_to_array(F.col(features)).alias("values"), F.col(label).cast("double").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))


# ---- growth ------------------------------------------------------------------------------
class Rows:
    """The rows of a task: their words of bins, and what is learned."""

    def __init__(self, batches: Iterator[pa.RecordBatch], n: int, points: Sequence[np.ndarray], bins: int, classes: bool):
        self.pack, self.varies = Packing(points, bins), np.array([len(p) > 0 for p in points])
        self.words, label, weight = np.empty((n, self.pack.words), np.int64), np.empty(n), np.empty(n)
        at = 0
        for b in batches:
            to, (_, ends, flat) = at + b.num_rows, b["bins"].buffers()
            # All values are as long as there are words, so they lie side by side.
            start = int(np.frombuffer(ends, np.int32)[b["bins"].offset])
            self.words[at:to] = np.frombuffer(flat, np.uint8)[start:start + b.num_rows * 8 * self.pack.words].view(np.int64).reshape(b.num_rows, -1)
            label[at:to], weight[at:to] = b["label"].to_numpy(), b["weight"].to_numpy()
            at = to
        if classes and not np.isin(label, (0.0, 1.0)).all():
            raise ValueError("classes are 0 and 1")
        if at != n:
            raise ValueError(f"{at} rows came, not {n}")
        self.kind = label.astype(np.uint8) if classes else np.zeros(n, np.uint8)
        self.shift = 0.0 if classes else float(np.average(label, weights=weight))
        self.value = None if classes else label - self.shift  # sums of values near zero keep their digits
        # Where all rows of a class weigh the same, draws are counted and the counts weighed.
        each = [weight[self.kind == k] for k in (0, 1)]
        self.even = np.array([e[0] if len(e) else 1.0 for e in each]) if all((e == e[:1]).all() for e in each) else None
        self.weight = weight if self.even is None else None

    def __len__(self) -> int:
        return len(self.words)

    def weights(self, at: np.ndarray) -> np.ndarray:
        return self.even[self.kind[at]] if self.weight is None else self.weight[at]


def drawn_features(rng: np.random.Generator, nodes: int, width: int, tried: int) -> np.ndarray:
    """For each node that many different features."""
    picked = np.empty((nodes, tried), np.intp)
    for j in range(tried):
        top = width - tried + j
        one = rng.integers(0, top + 1, nodes)
        picked[:, j] = np.where((picked[:, :j] == one[:, None]).any(1), top, one)
    return picked


def histograms(rows: Rows, rule: Growth, draws: np.ndarray, at: np.ndarray, sizes: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes and the features each tries, by bin: two sums (weight a class, or weight and weighted value), and draws.

    ``at`` are the rows of the nodes, one node after another.
    """
    (nodes, k), bins, pack = tried.shape, rule.bins, rows.pack
    word, shift = pack.word[tried], pack.shift[tried]
    sums, count, cells = np.zeros((2, nodes, k, bins)), np.zeros((nodes, k, bins)), nodes * bins
    node = np.repeat(np.arange(nodes), sizes)
    for a in range(0, len(at), STEP_ROWS):
        here, of = at[a:a + STEP_ROWS], node[a:a + STEP_ROWS]
        drawn = draws[here].astype(float)
        weight = drawn if rows.even is not None else drawn * rows.weight[here]
        value = None if rule.classes else weight * rows.value[here]
        by_word = np.ascontiguousarray(rows.words[here].T)
        flat, nth, base = by_word.ravel(), np.arange(len(here)), of * bins
        apart = base + rows.kind[here].astype(np.intp) * cells
        for j in range(k):
            if nodes == 1:
                bin_ = by_word[word[0, j]] >> shift[0, j] & pack.mask
            else:
                bin_ = flat.take((word[:, j] * len(here))[of] + nth) >> shift[:, j][of] & pack.mask
            if rule.classes:
                sums[:, :, j] += np.bincount(bin_ + apart, weight, 2 * cells).reshape(2, nodes, bins)
            else:
                code = bin_ + base
                sums[0, :, j] += np.bincount(code, weight, cells).reshape(nodes, bins)
                sums[1, :, j] += np.bincount(code, value, cells).reshape(nodes, bins)
            if rows.even is None:
                count[:, j] += np.bincount(bin_ + base, drawn, cells).reshape(nodes, bins)
    if rows.even is not None:
        count = sums[0] + sums[1] if rule.classes else sums[0].copy()
        sums *= rows.even[:, None, None, None] if rule.classes else rows.even[0]
    return sums, count


def best_splits(rule: Growth, sums: np.ndarray, count: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node: gain (0 if none is allowed), which of its features, the last bin to the left, sums and draws to the left and in all.

    ``many`` is the number of features a node tries; those after them are not its own.
    """
    left, below = np.cumsum(sums, -1), np.cumsum(count, -1)
    right, above = left[..., -1:] - left, below[..., -1:] - below
    total, drawn = left[:, :, 0, -1], below[:, 0, -1]

    def score(s: np.ndarray) -> np.ndarray:
        return (s[0] * s[0] + s[1] * s[1]) / (s[0] + s[1]) if rule.classes else s[1] * s[1] / s[0]

    whole = total.sum(0) if rule.classes else total[0]
    with np.errstate(all="ignore"):
        known = score(total)
        own = (np.arange(count.shape[1]) < many[:, None])[:, :, None]
        gains = np.where(own & (below >= rule.min_leaf) & (above >= rule.min_leaf), score(left) + score(right), -np.inf)
    nodes = np.arange(len(whole))
    best = gains.reshape(len(whole), -1).argmax(1)
    which, upto = np.divmod(best, rule.bins)
    gain = (gains[nodes, which, upto] - known) / whole
    # Less than the rounding of the sums is no gain.
    allowed = (gain > 1e-12 * np.abs(known) / whole) & (gain >= rule.min_gain)
    return np.where(allowed, gain, 0.0), which, upto, left[:, nodes, which, upto], below[nodes, which, upto], total, drawn


def blocks_of(sizes: np.ndarray, tried: int, bins: int) -> Iterator[tuple[int, int]]:
    """Runs of nodes whose rows and histograms fit a step; a node of many rows is a run of its own."""
    most, ends, a = max(1, NODE_CELLS // (2 * tried * bins)), np.cumsum(sizes), 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = min(a + most, max(a + 1, int(np.searchsorted(ends, before + STEP_ROWS, "right"))))
        yield a, b
        a = b


def grow(rows: Rows, rule: Growth, tree: int) -> dict[str, np.ndarray]:
    """The nodes of one tree, a level after another."""
    rng = np.random.default_rng([rule.seed & 0xFFFFFFFFFFFFFFFF, tree])
    n = len(rows)
    # A draw is a byte; more than 255 of one row are as good as impossible.
    draws = np.minimum(rng.poisson(rule.rate, n), 255).astype(np.uint8) if rule.draw else (rng.random(n) < rule.rate).astype(np.uint8)
    at = np.flatnonzero(draws).astype(np.int32)
    sizes = np.array([len(at)])
    weight, kind = draws[at] * rows.weights(at), rows.kind[at]
    sums = np.array([[weight[kind == 0].sum()], [weight[kind == 1].sum()]] if rule.classes else [[weight.sum()], [(weight * rows.value[at]).sum()]])
    count, levels, made = np.array([float(draws[at].sum())]), [], 1
    for depth in range(rule.depth + 1):
        m = len(sizes)
        starts = np.cumsum(sizes) - sizes
        level = {"gain": np.zeros(m), "feature": np.full(m, -1), "upto": np.zeros(m, int), "left": np.full(m, -1), "sums": sums, "count": count}
        if not rule.classes:
            w = draws[at] * rows.weights(at) * rows.value[at] ** 2
            level["squares"] = np.add.reduceat(w, starts) if len(w) else np.zeros(m)
        levels.append(level)
        open_ = (count >= 2 * rule.min_leaf) & ((sums > 0).all(0) if rule.classes else True) & (depth < rule.depth)
        if not open_.any():
            break
        at, ids = at[np.repeat(open_, sizes)], np.flatnonzero(open_)
        sizes = sizes[ids]
        starts = np.cumsum(sizes) - sizes
        parts, tried = [], drawn_features(rng, len(ids), len(rows.varies), rule.tried)
        # Features that are the same everywhere come last and are not looked at.
        tried = np.take_along_axis(tried, np.argsort(~rows.varies[tried], 1, "stable"), 1)
        many = rows.varies[tried].sum(1)
        for a, b in blocks_of(sizes, rule.tried, rule.bins):
            ends, own = starts[b - 1] + sizes[b - 1], tried[a:b, :max(1, many[a:b].max())]
            gain, which, *rest = best_splits(rule, *histograms(rows, rule, draws, at[starts[a]:ends], sizes[a:b], own), many[a:b])
            parts.append((gain, tried[np.arange(a, b), which], *rest))
        gain, feature, upto, left, below, total, drawn = (np.concatenate(p, -1) for p in zip(*parts))
        split = gain > 0
        if not split.any():
            break
        s = ids[split]
        pairs = len(s)
        level["gain"][s], level["feature"][s], level["upto"][s], level["left"][s] = gain[split], feature[split], upto[split], made + 2 * np.arange(pairs)
        made += 2 * pairs
        # The two children of a node lie side by side, their rows in the order they had.
        sums = np.stack([left[:, split], total[:, split] - left[:, split]], -1).reshape(2, -1)
        count = np.stack([below[split], drawn[split] - below[split]], -1).ravel()
        at, sizes = at[np.repeat(split, sizes)], sizes[split]
        of = np.repeat(np.arange(pairs, dtype=np.int32), sizes)
        word, shift = rows.pack.word[feature[split]][of], rows.pack.shift[feature[split]][of]
        low = rows.words[at, word] >> shift & rows.pack.mask <= upto[split][of]
        sides = np.bincount(of[low], minlength=pairs)
        before = np.cumsum(sizes) - sizes
        moved = np.empty_like(at)
        # Rows to the left of a node's split keep their order behind its start, the others behind those.
        lows = (np.cumsum(sides) - sides).astype(np.int32)
        moved[(before.astype(np.int32) - lows)[of[low]] + np.arange(low.sum(), dtype=np.int32)] = at[low]
        highs = (np.cumsum(sizes - sides) - (sizes - sides)).astype(np.int32)
        moved[((before + sides).astype(np.int32) - highs)[of[~low]] + np.arange(len(at) - low.sum(), dtype=np.int32)] = at[~low]
        at, sizes = moved, np.stack([sides, sizes - sides], -1).ravel()
    return pruned(levels, rows, rule)


def pruned(levels: list[dict], rows: Rows, rule: Growth) -> dict[str, np.ndarray]:
    """The nodes by level with what they predict; two leaves that predict the same are one."""
    out = {k: np.concatenate([x[k] for x in levels], -1) for k in levels[0]}
    sums, left = out["sums"], out["left"].copy()
    out["prediction"] = (sums[1] > sums[0]).astype(float) if rule.classes else rows.shift + sums[1] / sums[0]
    ends = np.cumsum([len(x["gain"]) for x in levels])
    for end, x in zip(ends[::-1], levels[::-1]):
        nodes = np.arange(end - len(x["gain"]), end)
        inner = nodes[left[nodes] >= 0]
        a = left[inner]
        same = (left[a] < 0) & (left[a + 1] < 0) & (out["prediction"][a] == out["prediction"][a + 1])
        left[inner[same]] = -1
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for end, x in zip(ends, levels):
        nodes = np.arange(end - len(x["gain"]), end)
        a = left[nodes[kept[nodes] & (left[nodes] >= 0)]]
        kept[a] = kept[a + 1] = True
    number = np.cumsum(kept) - 1
    out["left"] = np.where(left >= 0, number[left], -1)
    leaf = left < 0
    out["gain"], out["feature"] = np.where(leaf, -1.0, out["gain"]), np.where(leaf, -1, out["feature"])
    return {k: v[..., kept] for k, v in out.items()}


def node_rows(tree: int, t: dict[str, np.ndarray], points: Sequence[np.ndarray], rows: Rows, rule: Growth) -> pa.RecordBatch:
    """A tree in Spark's stored form."""
    n, (a, b) = len(t["gain"]), t["sums"]
    inner = t["feature"] >= 0
    if rule.classes:
        stats, impurity = np.stack([a, b], -1), 1.0 - (a * a + b * b) / (a + b) ** 2
    else:
        c = rows.shift
        stats = np.stack([a, b + c * a, t["squares"] + 2 * c * b + c * c * a], -1)
        impurity = np.maximum(t["squares"] / a - (b / a) ** 2, 0.0)
    edges = np.array([points[f][u] if f >= 0 else 0.0 for f, u in zip(t["feature"], t["upto"])])

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values, pa.float64()))

    split = pa.StructArray.from_arrays(
        [pa.array(t["feature"], pa.int32()), lists(edges[inner], inner), pa.array(np.full(n, -1), pa.int32())],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays(
        [pa.array(np.arange(n), pa.int32()), pa.array(t["prediction"]), pa.array(impurity), lists(stats.ravel(), np.full(n, stats.shape[1])),
         pa.array(np.rint(t["count"]).astype(np.int64)), pa.array(t["gain"]), pa.array(t["left"], pa.int32()),
         pa.array(np.where(inner, t["left"] + 1, -1), pa.int32()), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, tree), pa.int32()), data], ["treeID", "nodeData"])


def grower(points: Sequence[np.ndarray], rule: Growth, n: int, trees: Sequence[int]) -> Callable:
    """For ``mapInArrow`` over one partition of all ``n`` rows: the nodes of the trees, numbered from 0."""
    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(batches, n, points, rule.bins, rule.classes)
        for i, tree in enumerate(trees):
            yield node_rows(i, grow(rows, rule, tree), points, rows, rule)

    return of_rows
