"""Ranked lexical search: documents that look alike to the items are scored once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lower_ascii, small_batches, store

#: A term is a run of ASCII letters, ASCII digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as its terms want them: A-Z lower-cased, all that parts terms a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BAG = "doc_id long, n long, terms array<int>, counts array<int>"


@dataclass(frozen=True)
class RankRule:
    """Documents an item gets, share of a document's length in its score (of 100), distinct terms of items searched in one pass."""

    k: int = 50
    length: int = 50
    pass_terms: int = 1 << 18
    part: int = 1 << 20
    cells: int = 1 << 21


def terms_of(text) -> F.Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def tokens(raw: bytes, part: int) -> Iterator[list[bytes]]:
    """The terms of a text, in parts that no term crosses."""
    start = 0
    while start < len(raw):
        end = start + part
        while end < len(raw) and TERM_BYTES[raw[end]] != 32:
            end += 1
        yield raw[start:end].translate(TERM_BYTES).split()
        start = end


def bags(docs: DataFrame, vocabulary: list[bytes], rule: RankRule) -> DataFrame:
    """Documents with a term: their number of terms, and the item terms among them with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {term: i for i, term in enumerate(shared.value)}
        for batch in batches:
            kept, sizes, ends, terms, counts = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                n, found = 0, Counter()
                for part in tokens(text.as_py() or b"", rule.part):
                    n += len(part)
                    found.update(map(known.get, part))
                if n:
                    found.pop(None, None)
                    mine = sorted(found.items())
                    kept.append(row)
                    sizes.append(n)
                    terms += [t for t, _ in mine]
                    counts += [c for _, c in mine]
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))], schema=fields
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, BAG)


def classes(found: DataFrame, n_docs: int, n_terms: int, rule: RankRule) -> DataFrame:
    """One row per bag (item terms, their counts and the length term ``m``) with its first ``k`` members.

    Bags are brought together by their hash and told apart by their contents.
    No item takes more than ``k`` documents, so later members of a bag cannot be
    in a result; every task drops them before anything is shuffled, and a bag
    shared by a third of the documents is no hot key.
    """
    m = F.expr(f"{100 - rule.length}L + ({rule.length}L * n * {n_docs}L) div {n_terms}L")
    bag = found.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "counts").withColumn("hash", F.xxhash64("m", "terms", "counts"))
    same = ["hash", "m", "terms", "counts"]
    first = bag.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("place") <= rule.k)
    members = F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id"))), lambda s: s["doc_id"])
    return first.groupBy(*same).agg(members.alias("members")).drop("hash")


def scored(bag: DataFrame, weights: np.ndarray, items: list[tuple], rule: RankRule) -> DataFrame:
    """``item, item_id, score, members``: for every item all bags that may be among its best ``k``, each scored once.

    A task keeps the ``k`` best scores it has seen of every item and passes on
    only bags that reach them.
    """
    holders = [[] for _ in weights]
    for i, (_, terms) in enumerate(items):
        for t in terms:
            holders[t].append(i)
    ends = np.cumsum([0, *map(len, holders)])
    shared = bag.sparkSession.sparkContext.broadcast((weights, ends, np.array([i for h in holders for i in h], np.int64), [i for i, _ in items]))
    fields = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("score", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, end, holder, ids = shared.value
        ids = pa.array(ids, pa.int64())
        best = np.zeros((len(ids), rule.k), np.int64)
        for batch in batches:
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            term, count = np.asarray(lists.flatten()), np.asarray(batch.column(2).flatten()).astype(np.int64)
            m = np.asarray(batch.column(0))[row]
            gain = weight[term] * ((10**9 * count) // (1000 * count + 20 * m))
            reach = end[term + 1] - end[term]  # items that a row of (bag, term) counts for
            work = np.bincount(row, weights=reach, minlength=batch.num_rows).astype(np.int64) + len(ids)
            group = np.cumsum(work) // rule.cells
            for low, high in _runs(group):
                here = slice(*np.searchsorted(row, [low, high]))
                times = reach[here]
                start = np.repeat(end[term[here]] - (np.cumsum(times) - times), times)
                item = holder[start + np.arange(len(start))]
                scores = np.zeros(len(ids) * (high - low), np.int64)
                np.add.at(scores, item * (high - low) + np.repeat(row[here] - low, times), np.repeat(gain[here], times))
                scores = scores.reshape(len(ids), high - low)
                both = np.concatenate([best, scores], axis=1)
                best = np.partition(both, both.shape[1] - rule.k, axis=1)[:, -rule.k :]
                of, at = np.nonzero(scores >= np.maximum(best.min(axis=1), 1)[:, None])
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), ids.take(pa.array(of)), pa.array(scores[of, at]), batch.column(3).take(pa.array(at + low))], schema=fields)

    return bag.select("m", "terms", "counts", "members").mapInArrow(run, "item int, item_id long, score long, members array<long>")


def _runs(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """First row and end of each run of equal numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
    return ((int(a), int(b)) for a, b in zip(cuts, cuts[1:]) if a < b)


def _one_pass(docs: DataFrame, items: list[tuple], rule: RankRule) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    found, _ = store(bags(docs, [t.encode() for t in vocabulary], rule), "lexical-bags")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    held = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    candidates = scored(classes(found, n_docs, n_terms, rule), weights, [(i, [number[t] for t in terms]) for i, terms in items], rule)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("members")[0].asc_nulls_last())
    chosen = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rule.k)
    expanded = chosen.select("item", "item_id", "score", F.explode("members").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return expanded.withColumn("rank", rank).where(F.col("rank") <= rule.k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, rule: RankRule = RankRule()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``rule.k`` best documents (``doc_id, text``) of each item (``item_id, text``).

    Every document is cut down to the terms that any item has. Documents with
    equal terms, counts and length term are one class, which is scored once
    against all items that share a term with it; the members of the best classes
    then take the ranks, equal scores by ascending ``doc_id``, null ids last.

    Null, empty and termless texts have no terms and are neither counted nor
    found. A document row counts by itself, also if its id or the whole row
    repeats. Rows of one item id with the same set of terms are one item;
    other texts under that id are ranked each by itself. Whole texts are read, however long, a part at a time.
    Other columns are ignored; without documents or items there are no rows.

    Items are a stated set of queries: about ``rule.pass_terms`` distinct terms
    at a time go to the driver and to all tasks, more items take more passes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_sort(F.array_distinct(terms_of(F.col("text")))).alias("terms")).where(F.size("terms") > 0).distinct()
    wanted, path = store(wanted, "lexical-items")
    passes = max(1, math.ceil((wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) / rule.pass_terms))
    found = []
    for p in range(passes):
        part = [(r["item_id"], r["terms"]) for r in wanted.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes)) == p).collect()]
        if part and (made := _one_pass(docs, part, rule)) is not None:
            found.append(made if passes == 1 else store(made, "lexical-found")[0])
    drop(spark, path)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
