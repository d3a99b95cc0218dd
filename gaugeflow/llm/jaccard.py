"""Jaccard self-join of word-shingle sets by signature trees.

Sets that differ in at most ``H`` shingles agree in all but ``H`` parts of any
cut of the hash space. So documents that can link share a part of at least one
cut exactly, and such parts are the groups within which trees of OR-combined
bitmaps are traversed. Everything is exact but for collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import sent_if_small, small_batches, store
from .components import components

GOLD, MIX_A, MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
LEAF = 16  # documents of a leaf, nodes of a node
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class JaccardRule:
    """Words of a shingle; two sets link when ``den * intersection >= num * union``.

    ``part`` is the least size of an equal part that makes a group, ``spare``
    the share of further parts cut to afford it; ``block`` and ``weight`` bound
    the documents and shingles of one side of a task.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    part: int = 3
    spare: float = 0.15
    block: int = 2048
    weight: int = 1 << 21
    memo: int = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts; words are hashed once per worker."""

    def __init__(self, rule: JaccardRule):
        import xxhash

        class Memo(dict):
            def __missing__(self, word):
                value = self[word] = xxhash.xxh3_64_intdigest(word)
                return value

        self.rule, self.memo = rule, Memo()
        with np.errstate(over="ignore"):
            self.odd = mix(np.arange(1, rule.words + 1, dtype=np.uint64) * GOLD) | np.uint64(1)

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """Distinct 64-bit shingle hashes, ascending; a text of fewer words is one shingle."""
        words = raw.lower().split() if raw else []
        if len(self.memo) > self.rule.memo:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))
        k = self.rule.words
        if not len(h):
            return h
        if len(h) < k:
            return mix(np.array([int((h * self.odd[:len(h)]).sum()) ^ len(h)], dtype=np.uint64))
        rolled = h[:len(h) - k + 1] * self.odd[0]
        for j in range(1, k):
            rolled += h[j:len(h) - k + 1 + j] * self.odd[j]
        return np.unique(mix(rolled))


def set_id(shingles: np.ndarray) -> int:
    """One number for a set."""
    return int(mix(np.array([mix(shingles + GOLD).sum() + np.uint64(len(shingles)) * MIX_A], dtype=np.uint64)).astype(np.int64)[0])


def size_classes() -> list[int]:
    """Least sizes of the size classes, each about half as large again as the one before."""
    out = [1, 2, 3, 4]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 3 // 2)
    return out


CLASSES = size_classes()


def most_apart(sizes, rule: JaccardRule):
    """Most shingles in which two linked sets of this summed size can differ."""
    return (rule.den - rule.num) * sizes // (rule.den + rule.num)


def group_keys(shingles: np.ndarray, rule: JaccardRule) -> np.ndarray:
    """The equal-part keys of a set.

    The cut of a size class serves pairs whose larger set is in the class; a set
    uses that of its own class and of those above in which a partner may lie.
    With ``q`` parts a pair agrees in ``q - H`` at least, so a set whose parts
    under a size number fewer than that may leave those out.
    """
    n, found = len(shingles), []
    at = int(np.searchsorted(CLASSES, n, side="right")) - 1
    largest = n * rule.den // rule.num
    for layer in range(at, int(np.searchsorted(CLASSES, largest, side="right"))):
        top = CLASSES[layer + 1] - 1
        own = most_apart(n + min(largest, top), rule)
        if not own:  # nothing but an equal set can link
            continue
        q = int(most_apart(2 * top, rule) * (1 + rule.spare)) + 3
        part = ((shingles >> np.uint64(32)) * np.uint64(q)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part.astype(np.int64), minlength=q)
        least = next(m for m in range(rule.part, -1, -1) if m == 0 or (counts < m).sum() < q - own)
        sums = np.zeros(q, dtype=np.uint64)
        full = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        sums[full] = np.add.reduceat(mix(shingles[order] ^ GOLD), starts)
        chosen = np.flatnonzero(counts >= least)
        found.append(mix(sums[chosen] + mix(np.uint64(layer << 40) + chosen.astype(np.uint64)) + counts[chosen].astype(np.uint64)))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit per shingle, in at least as many bits; a power of two of words."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    mask = np.zeros(bits, dtype=bool)
    mask[(shingles & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(mask, bitorder="little").view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps brought to the shortest length: bit ``h`` of a longer one goes to ``h`` modulo that length."""
    width = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


class Tree:
    """Levels of nodes over documents: OR- and AND-combined bitmaps and size ranges; leaves keep to one side."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, sides: np.ndarray):
        self.order = np.lexsort((*bits.T[:3], sizes, sides))
        side = sides[self.order]
        turn = np.flatnonzero(np.diff(side)) + 1
        starts = np.concatenate([np.arange(a, b, LEAF) for a, b in zip([0, *turn], [*turn, len(side)])])
        self.starts, self.ends, self.side = starts, np.append(starts[1:], len(side)), side[starts]
        bits, sizes = bits[self.order], sizes[self.order]
        self.levels = []
        while True:
            level = (np.bitwise_or.reduceat(bits, starts, axis=0), np.bitwise_and.reduceat(self.levels[-1][1] if self.levels else bits, starts, axis=0),
                     np.minimum.reduceat(self.levels[-1][2] if self.levels else sizes, starts), np.maximum.reduceat(self.levels[-1][3] if self.levels else sizes, starts))
            self.levels.append(level)
            if len(starts) <= LEAF:
                return
            bits, starts = level[0], np.arange(0, len(starts), LEAF)

    def leaf_pairs(self, rule: JaccardRule) -> np.ndarray:
        """Pairs of leaves that may hold a link: node pairs go where their largest possible overlap is too small."""
        top = len(self.levels[-1][2])
        i, j = np.triu_indices(top)
        for depth in range(len(self.levels) - 1, -1, -1):
            if depth < len(self.levels) - 1:
                n = len(self.levels[depth][2])
                step = np.arange(LEAF)
                a = (i[:, None, None] * LEAF + step[None, :, None]) + np.zeros((1, 1, LEAF), dtype=np.int64)
                b = (j[:, None, None] * LEAF + step[None, None, :]) + np.zeros((1, LEAF, 1), dtype=np.int64)
                live = (a < n) & (b < n) & ((i != j)[:, None, None] | (a <= b))
                i, j = a[live], b[live]
            some, every, least, most = self.levels[depth]
            keep = (most[i] * rule.den >= rule.num * least[j]) & (most[j] * rule.den >= rule.num * least[i])
            i, j = i[keep], j[keep]
            room = max(1, (1 << 20) // some.shape[1])
            fits = [np.zeros(0, bool)]
            for k in range(0, len(i), room):
                x, y = i[k:k + room], j[k:k + room]
                apart = np.bitwise_count(every[x] & ~some[y]).sum(axis=1) + np.bitwise_count(every[y] & ~some[x]).sum(axis=1)
                fits.append((apart <= most_apart(most[x] + most[y], rule)) | (x == y))
            fit = np.concatenate(fits)
            i, j = i[fit], j[fit]
        near = np.argsort(j - i, kind="stable")  # neighbours first: what they connect need not be compared again
        return np.stack([i[near], j[near]], axis=1)


def spanning_links(ids: list[int], sizes: np.ndarray, maps: list[np.ndarray], sides: np.ndarray, labels: list[int], verify: Callable[[int, int], bool] | None, rule: JaccardRule) -> list[tuple[int, int]]:
    """Links that connect what any links of the group connect.

    ``sides`` 0 and 1: only pairs across; all 2: all pairs. Documents of equal
    ``labels`` are connected already. Without ``verify`` a pair links if its
    bitmaps do not rule it out.
    """
    parent, first = list(range(len(ids))), {}
    for k, label in enumerate(labels):
        parent[k] = first.setdefault(label, k)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    bits = folded(maps)
    tree, out = Tree(bits, sizes, sides), []
    cross = bool((sides < 2).any())
    members = [tree.order[a:b] for a, b in zip(tree.starts, tree.ends)]
    pairs = tree.leaf_pairs(rule)
    if cross:
        pairs = pairs[tree.side[pairs[:, 0]] != tree.side[pairs[:, 1]]]
    uniform: dict[int, int] = {}

    def one_root(leaf: int) -> int | None:
        if leaf in uniform:
            return root(uniform[leaf])
        roots = {root(k) for k in members[leaf].tolist()}
        if len(roots) == 1:
            uniform[leaf] = next(iter(roots))
            return uniform[leaf]
        return None

    for x, y in pairs.tolist():
        rx = one_root(x)
        if rx is not None and rx == one_root(y):
            continue
        a, b = members[x], members[y]
        apart = np.bitwise_count(bits[a][:, None, :] ^ bits[b][None, :, :]).sum(axis=2, dtype=np.int64)
        na, nb = sizes[a][:, None], sizes[b][None, :]
        may = (apart <= most_apart(na + nb, rule)) & (na * rule.den >= rule.num * nb) & (nb * rule.den >= rule.num * na)
        if x == y:
            may = np.triu(may, 1)
        for p, q in zip(*(v.tolist() for v in np.nonzero(may))):
            p, q = int(a[p]), int(b[q])
            rp, rq = root(p), root(q)
            if rp != rq and (verify is None or verify(p, q)):
                parent[max(rp, rq)] = min(rp, rq)
                out.append((ids[p], ids[q]))
    return out


def as_stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ``links`` connect, each id hung directly under the least one it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def linked(a: np.ndarray, b: np.ndarray, rule: JaccardRule) -> bool:
    at = np.minimum(b.searchsorted(a), len(b) - 1)
    both = int((b[at] == a).sum())
    return rule.den * both >= rule.num * (len(a) + len(b) - both)


KEYS = ["g", "low", "high"]


def _run_tasks(tasks: DataFrame, exact: bool, rule: JaccardRule) -> DataFrame:
    """Each task's spanning links; ``tasks``: ``g, low, high, side, cid, n, label, bits, shingles``."""

    def solve(held: list[tuple]) -> list[tuple[int, int]]:
        rows = list({(r[0], r[1]): r for r in held}.values())  # side and set
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in rows] if exact else None
        verify = (lambda p, q: linked(sets[p], sets[q], rule)) if exact else None
        return as_stars(spanning_links(
            [r[1] for r in rows], np.array([r[2] for r in rows]), [np.frombuffer(r[4], dtype=np.uint64) for r in rows], np.array([r[0] for r in rows]), [r[3] for r in rows], verify, rule
        ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            rows = zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)))
            for key, row in zip(keys, rows):
                if key != now:
                    out += solve(held)
                    now, held = key, []
                held.append(row if exact else (*row, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=EDGES)
                out = []
        if out := solve(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=EDGES)

    columns = [*KEYS, "side", "cid", "n", "label", "bits", *["shingles"] * exact]
    return tasks.select(*columns).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, "a long, b long")


def _blocks(count: str, weight: str, rule: JaccardRule):
    return F.greatest(F.ceil(F.col(count) / F.lit(rule.block)), F.ceil(F.col(weight) / F.lit(rule.weight))).cast("int")


def link_groups(rows: DataFrame, exact: bool, rule: JaccardRule) -> DataFrame:
    """Links (``a, b``) that connect each group ``g`` as all its links would; ``rows``: ``g, cid, n, bits, shingles``.

    A group that fits a task is one. A larger one is cut into blocks: first all
    blocks meet the first block, which connects a crowd of near copies at once;
    then the documents outside the group's largest component, if any, meet all.
    """
    sizes = rows.groupBy("g").agg(F.count("*").alias("docs"), F.sum("n").alias("weight")).where("docs > 1")
    sizes, _ = store(sizes.select("g", _blocks("docs", "weight", rule).alias("blocks")), "jaccard-groups")
    cut = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    zero = F.lit(0)
    everyone = F.when((F.col("own") == 0) & (F.col("blocks") > 1), F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("own"))
    side = F.when(F.col("high") == 0, 2).when(F.col("own") == 0, 0).otherwise(1)
    tasks = cut.withColumn("high", F.explode(everyone)).withColumns({"low": zero, "side": side, "label": F.col("cid")})
    edges, _ = store(_run_tasks(tasks, exact, rule), "jaccard-links")
    large = sizes.where("blocks > 1")
    if not large.take(1):
        return edges
    labels = components(edges).select(F.col("node").alias("cid"), "label")
    crowd = rows.join(large.select("g"), "g", "left_semi").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    crowd, _ = store(crowd, "jaccard-crowd")
    shares = crowd.groupBy("g", "label").agg(F.count("*").alias("docs"))
    largest = shares.groupBy("g").agg(F.max(F.struct("docs", "label"))["label"].alias("main"))
    rest = crowd.join(largest, "g").where("label <> main").drop("main")
    few = rest.groupBy("g").agg(F.count("*").alias("docs"), F.sum("n").alias("weight")).select("g", _blocks("docs", "weight", rule).alias("parts"))
    both, _ = store(few.join(sizes, "g"), "jaccard-rest")
    part = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    ones = rest.join(both, "g").withColumns({"low": part, "side": zero}).withColumn("high", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    others = crowd.join(both, "g").withColumns({"high": block, "side": F.lit(1)}).withColumn("low", F.explode(F.sequence(zero, F.col("parts") - 1)))
    columns = [*KEYS, "side", "cid", "n", "label", "bits", "shingles"]
    return edges.unionByName(_run_tasks(ones.select(columns).unionByName(others.select(columns)), exact, rule))


def _over_texts(rule: JaccardRule, each: Callable) -> Callable:
    def run(batches):
        shingler = Shingler(rule)
        with np.errstate(over="ignore"):
            yield from each(batches, shingler)

    return run


def digests(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """``doc_id, row_key, n_shingles, cid`` of every document; ``row_key`` hashes id and text, ``cid`` the set (null if empty)."""

    def each(batches, shingler):
        for batch in batches:
            sets = [shingler(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "row_key", "n_shingles", "cid"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text"), F.col("text").cast("binary"))
    return given.mapInArrow(_over_texts(rule, each), "doc_id long, row_key long, n_shingles long, cid long")


def part_keys(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """``key, cid`` for the parts of every set; a task gives those of a set once."""

    def each(batches, shingler):
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column(0):
                s = shingler(text.as_py())
                if len(s) and (cid := set_id(s)) not in seen:
                    seen.add(cid)
                    k = group_keys(s, rule)
                    keys.append(k)
                    owners.append(np.full(len(k), cid))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "cid"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(_over_texts(rule, each), "key long, cid long")


def sets_of(texts: DataFrame, rule: JaccardRule) -> DataFrame:
    """``cid, n, bits, shingles`` of texts; a task gives a set once."""

    def each(batches, shingler):
        seen: set[int] = set()
        for batch in batches:
            rows, held = [], 0
            for text in batch.column(0):
                s = shingler(text.as_py())
                if len(s) and (cid := set_id(s)) not in seen:
                    seen.add(cid)
                    rows.append((cid, len(s), bitmap(s).tobytes(), s.tobytes()))
                    held += len(rows[-1][3])
                if held > 8 << 20:
                    yield _set_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _set_batch(rows)

    return texts.select(F.col("text").cast("binary")).mapInArrow(_over_texts(rule, each), "cid long, n long, bits binary, shingles binary")


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["cid", "n", "bits", "shingles"])


def join_documents(docs: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, is_head`` of every document.

    ``component_id`` is the least ``doc_id`` that links reach; ``is_head`` marks
    the document of that id (of several rows of it, those of the least key).

    Documents of equal sets are one node. Null, empty and blank texts have no
    shingle, link with nothing and are their own component and head. Fewer words
    than a shingle: the whole sequence is one. Null ids come last in a
    component. Rows that agree in everything share the mark. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, _ = store(digests(docs, rule), "jaccard-docs")
    by_key = W.Window.partitionBy("key")
    met = part_keys(docs, rule).select(
        "cid", F.min("cid").over(by_key).alias("low"), F.max("cid").over(by_key).alias("high"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).over(by_key).alias("all")
    ).where("low < high")
    # Parts shared by the same sets make one group.
    groups, _ = store(met.select(F.xxhash64("low", "high", "all").alias("g"), "cid").distinct(), "jaccard-parts")
    wanted = groups.select("cid").distinct().join(rows.where("cid is not null").groupBy("cid").agg(F.min("row_key").alias("row_key")), "cid")
    wanted, _ = store(wanted.select(F.col("row_key").alias("wanted")), "jaccard-wanted")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").join(sent_if_small(wanted), F.col("row_key") == F.col("wanted"), "left_semi")
    sets, _ = store(sets_of(texts, rule), "jaccard-sets")
    may = link_groups(groups.join(sets.select("cid", "n", "bits", F.lit(None).cast("binary").alias("shingles")), "cid"), False, rule)
    loose, _ = store(components(may), "jaccard-loose")
    crowds = loose.select(F.col("label").alias("g"), F.col("node").alias("cid"))
    sure = link_groups(sets.join(sent_if_small(crowds), "cid"), True, rule)
    labels, _ = store(components(sure).select(F.col("node").alias("cid"), "label"), "jaccard-labels")
    labelled = rows.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key"))
    heads = labelled.where("label is not null").groupBy("label").agg(first.alias("first")).select("label", F.col("first.doc_id").alias("head_id"), F.col("first.row_key").alias("head_key"))
    full = labelled.join(heads, "label", "left")
    alone = F.col("label").isNull()
    return full.select(
        "doc_id", "row_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head_id")).alias("component_id"),
        (alone | (F.col("row_key") == F.col("head_key"))).alias("is_head"),
    )


def keep_heads(docs: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """``docs`` with one document of each component and all that link with nothing; its columns unchanged.

    Of rows that agree in id and text one stays; texts without a word all stay.
    """
    heads = join_documents(docs, rule).where("is_head").select(F.col("row_key").alias("head"), (F.col("n_shingles") == 0).alias("blank")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("head")).join(heads, "head")
    numbered = keyed.withColumn("nth", F.row_number().over(W.Window.partitionBy("head").orderBy(F.lit(0))))
    return numbered.where("nth = 1 or blank").select("row.*")
