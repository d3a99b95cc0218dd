"""Mix sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, store, unit

SNAP = 1e-9  # a probability this close to 0 or 1 is taken as decided


@dataclass(frozen=True)
class MixRule:
    """Weights by rank of the source, most copies of a document, leaves of a node of the reduction tree."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most: float = 3.0
    fan: int = 512
    seed: int = 17


def let(value: Column, body) -> Column:
    """Bind ``value`` once within an expression."""
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """``source, source_size, n`` with ``target``: shares by weight, capped, the excess shared anew.

    All targets are ``min(most * size, level * weight)``: sources ordered by the
    level at which they reach their cap give the level from running sums. The
    windows run over one row per source.
    """
    weights = F.array(*[F.lit(float(w)) for w in rule.weights])
    every = W.Window.partitionBy()
    ranked = (
        sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weights[F.pmod(F.col("rank") - 1, F.lit(len(rule.weights)))])
        .withColumn("cap", F.lit(rule.most) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    before = every.orderBy("full_at", "rank").rowsBetween(W.Window.unboundedPreceding, -1)
    levelled = ranked.withColumns({
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    # The first source whose cap lies above the level that the earlier caps leave.
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(every)["level"]
    return levelled.withColumn("target", F.least(F.col("cap"), F.coalesce(found, F.lit(math.inf)) * F.col("weight"))).select("source", "source_size", "n", "target")


def _snapped(p: Column) -> Column:
    return let(p, lambda v: F.when(v < SNAP, F.lit(0.0)).when(v > 1 - SNAP, F.lit(1.0)).otherwise(v))


ITEM = "struct<key:bigint,occ:int,size:double,p:double>"


def _decide(state: Column, x: Column) -> Column:
    """One pivotal step: words move between a document and all smaller ones of its node, taken as one, until either is decided.

    ``a, b``: a document not yet met has come from ``p`` to ``a * p + b``, since
    what the pool gives or gets is shared by all its members alike. ``m, s``: words
    due and words of the documents not yet met, before that map.
    """
    def facts(p):
        s, m = state["s"] - x["size"], state["m"] - x["p"] * x["size"]
        due = F.greatest(F.lit(0.0), F.least(state["a"] * m + state["b"] * s, s))
        return F.struct(p.alias("p"), s.alias("s"), m.alias("m"), due.alias("due"), (s - due).alias("free"))

    def limits(f):
        up, down = F.least((1 - f["p"]) * x["size"], f["due"]), F.least(f["p"] * x["size"], f["free"])
        return F.struct(f.alias("f"), up.alias("up"), down.alias("down"))

    def drawn(v):
        fixed = v["f"]["p"].isin(0.0, 1.0) | (v["up"] + v["down"] <= 0)
        d = F.when(fixed, F.lit(0.0)).when(x["u"] * (v["up"] + v["down"]) < v["down"], v["up"]).otherwise(-v["down"])
        return F.struct(v["f"].alias("f"), d.alias("d"))

    def result(v):
        f, d = v["f"], v["d"]
        left = F.when(d > 0, 1 - d / f["due"]).when(d < 0, 1 + d / f["free"]).otherwise(1.0)
        return F.struct(f.alias("f"), d.alias("d"), _snapped(f["p"] + d / x["size"]).alias("p"), F.when(left < SNAP, F.lit(0.0)).otherwise(left).alias("left"))

    def after(r):
        item = F.struct(x["key"].alias("key"), x["occ"].alias("occ"), x["size"].alias("size"), r["p"].alias("p"))
        decided = r["p"].isin(0.0, 1.0)
        return F.struct(
            (state["a"] * r["left"]).alias("a"), (state["b"] * r["left"] + F.when(r["d"] < 0, 1 - r["left"]).otherwise(0.0)).alias("b"),
            r["f"]["m"].alias("m"), r["f"]["s"].alias("s"), F.when(decided, state["open"]).otherwise(item).alias("open"),
            F.when(decided, F.concat(state["done"], F.array(item))).otherwise(state["done"]).alias("done"))

    p = _snapped(state["a"] * x["p"] + state["b"])
    return let(let(let(let(let(p, facts), limits), drawn), result), after)


def _fold(level: DataFrame, draw: Column) -> DataFrame:
    """Each node's decided documents and its one undecided rest; ``draw`` is new at every level.

    Large documents are decided first, so the rest is the smallest one, or one
    that all smaller ones together cannot outweigh.
    """
    item = F.struct((-F.col("size")).alias("order"), "key", "occ", "size", "p", draw.alias("u"))
    nodes = level.groupBy("source", "node").agg(F.array_sort(F.collect_list(item)).alias("items"))
    total = lambda value: F.aggregate("items", F.lit(0.0), lambda acc, x: acc + value(x))
    start = F.struct(
        F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), total(lambda x: x["p"] * x["size"]).alias("m"), total(lambda x: x["size"]).alias("s"),
        F.lit(None).cast(ITEM).alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    return nodes.select("source", "node", F.aggregate("items", start, _decide).alias("folded")).select("source", "node", "folded.open", "folded.done")


def mix(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """How often the mix takes each document.

    A row per document: ``doc_id, source, key, occ, size`` (words), ``source_size,
    target`` (its source's), ``copies``, ``taken`` (words). ``key`` hashes id,
    source and text; ``occ`` numbers rows that agree in all three.

    Every document owes its source the ratio target / size of copies: the whole
    part is given at once, the fraction is rounded. Documents of a source are
    dealt by hash to the leaves of a tree; in a node of about ``rule.fan``
    documents words move between the largest undecided one and the pool of all
    smaller ones, by a fair draw that leaves every document's expectation and the
    node's total unchanged, until one of the two is decided. A node's one rest
    goes to its parent, so a source of any size is spread over many tasks and its
    total is off by one document at most, a small one unless it outweighs the
    rest of its source. Draws hash the row's values: reruns agree.

    Null source: a source of its own, ranked last. Null or empty text: size 0,
    its fraction is drawn alone and it takes no words. Rows that agree in
    everything are told apart by number. An empty table gives no rows. Columns
    other than ``doc_id, source, text`` are not read.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("key")
    )
    rows, _ = store(narrow.withColumn("occ", F.row_number().over(W.Window.partitionBy("key").orderBy(F.lit(0)))), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets, _ = store(source_targets(sizes, rule), "mix-targets")
    shares = targets.withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(rule.most), F.col("target") / F.col("source_size"))).otherwise(F.lit(1.0))
    due = rows.join(shares, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("ratio", ratio)
    due = due.withColumn("whole", F.floor(F.col("ratio") + SNAP)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    due, _ = store(due.withColumn("open", (F.col("p") > SNAP) & (F.col("size") > 0)), "mix-due")

    top = targets.agg(F.max("n")).first()[0] or 0
    leaves = F.ceil(F.col("n") / F.lit(rule.fan)).cast("long")
    leaf = F.pmod(F.xxhash64(F.lit(rule.seed), "key", "occ"), leaves)
    level = due.where("open").select("source", leaf.alias("node"), "key", "occ", F.col("size").cast("double").alias("size"), "p")
    extra, nodes, height = None, max(1, math.ceil(top / rule.fan)), 1
    while True:
        folded, _ = store(_fold(level, unit(F.lit(rule.seed + height), F.col("key"), F.col("occ"))), "mix-level")
        done = folded.select(F.explode("done").alias("x")).select("x.key", "x.occ", F.col("x.p").cast("int").alias("extra"))
        extra = done if extra is None else extra.unionByName(done)
        rest = folded.where(F.col("open").isNotNull()).select("source", "node", "open.*")
        if nodes == 1:
            break
        nodes, height = math.ceil(nodes / rule.fan), height + 1
        level = rest.withColumn("node", F.expr(f"node div {rule.fan}"))
    drawn = (unit(F.lit(rule.seed), F.col("occ"), F.col("key")) < F.col("p")).cast("int").alias("extra")
    extra = extra.unionByName(rest.select("key", "occ", drawn))
    got = due.where("open").join(extra, ["key", "occ"])
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return due.where("not open").withColumn("extra", drawn).unionByName(got).select(
        "doc_id", "source", "key", "occ", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns unchanged.

    Cases as in ``mix``; a document of no words stays or goes by its draw.
    """
    plan = mix(docs, rule).where("copies > 0").select("key", "occ", "copies")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "source", "text").alias("key"))
    keyed = keyed.withColumn("occ", F.row_number().over(W.Window.partitionBy("key").orderBy(F.lit(0))))
    repeated = keyed.join(plan, ["key", "occ"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("row.*")
