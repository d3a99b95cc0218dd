"""Class-based bigram language model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store

BANDS = 32  # bands of word counts per doubling
SHARES = 1 << 12  # parts of the words of one count, by hash
END, OTHER, FIRST = 0, 1, 2  # the end of a text, any word outside the head, the first head word


@dataclass(frozen=True)
class ClassRule:
    """Classes, words clustered by exchange, words placed beside them, words of the head, rounds.

    The ``core`` most frequent words are clustered by exchange; those up to
    ``placed`` (the whole head, unless told otherwise) then each take the
    likeliest class, given the core's; the rest of the head, if any, is classed
    by rank, a class for every doubling. The head is held by every worker, so its
    size is fixed, and a word of more than ``longest`` bytes is held by its
    digest; all other words share one class, in which each keeps its own count.
    """

    classes: int = 64
    core: int = 1024
    placed: int = 1 << 17
    head: int = 1 << 17
    longest: int = 64
    rounds: int = 4
    smooth: float = 0.5
    flush: int = 250_000


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII letters lowered, split at ASCII white space."""
    return text.lower().split() if text else []


def _texts(batch: pa.RecordBatch, column: int = 0):
    for value in batch.column(column):
        yield value.as_py()


def word_counts(docs: DataFrame, rule: ClassRule) -> DataFrame:
    """``word`` (bytes; null for the ends of texts) with ``n``, over all words of all texts."""

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                counts.update(words_of(text))
            counts[None] += batch.num_rows
            if len(counts) > rule.flush:
                yield out(counts)
                counts = Counter()
        if counts:
            yield out(counts)

    part = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """Ids of the frequent words; one of more than ``longest`` bytes is known by its digest."""

    def __init__(self, words: list[bytes], longest: int):
        self.ids = {w: k for k, w in enumerate(words, FIRST)}
        self.longest = longest

    def sequence(self, words: list[bytes]) -> np.ndarray:
        """Ids of a text between two ends."""
        out = np.full(len(words) + 2, END, dtype=np.int64)
        words = [w if len(w) <= self.longest else hashlib.sha256(w).digest() for w in words]
        out[1:-1] = np.fromiter(map(self.ids.get, words, repeat(OTHER)), np.int64, count=len(words))
        return out


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of the greatest ``n``; where a count does not fit, its words by hash.

    Cut by bands of counts, in the last band by counts, among the words of the
    last count by shares of their hashes, in the last share by word.
    """
    cuts = [
        F.floor(F.log2("n") * BANDS),
        F.col("n"),
        F.pmod(F.xxhash64("word"), F.lit(SHARES)),
    ]
    taken, rest = F.lit(False), F.lit(True)
    for cut in cuts:
        room, last = most, None
        for row in words.where(rest).groupBy(cut.alias("cut")).agg(F.count("*").alias("words")).orderBy(F.desc("cut")).collect():
            if row["words"] > room:
                last = row["cut"]
                break
            room -= row["words"]
        if last is None:
            return words.where(taken | rest)
        taken, rest, most = taken | (rest & (cut > last)), rest & (cut == last), room
    return words.where(taken).unionByName(words.where(rest).orderBy("word").limit(most))


def pair_counts(docs: DataFrame, shared, kinds: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``kind, a, b, n``: neighbouring ids of all texts as each kind's two maps give them; -1 leaves a pair out.

    A task sums into one table per kind, of the size that the maps span.
    """
    shapes = [(int(left.max()) + 1, int(right.max()) + 1) for left, right in kinds]
    maps = docs.sparkSession.sparkContext.broadcast(kinds)

    def run(batches):
        sums = [np.zeros(max(1, x * y), dtype=np.int64) for x, y in shapes]
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                s = np.concatenate([shared.value.sequence(words_of(t)) for t in _texts(batch.slice(start, 100))])
                for total, (left, right), (_, width) in zip(sums, maps.value, shapes):
                    a, b = left[s[:-1]], right[s[1:]]
                    live = (a >= 0) & (b >= 0) & ~((s[:-1] == END) & (s[1:] == END))
                    np.add.at(total, a[live] * width + b[live], 1)
        for kind, (total, (_, width)) in enumerate(zip(sums, shapes)):
            found = np.flatnonzero(total)
            for at in np.split(found, range(1 << 18, len(found), 1 << 18)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at // width), pa.array(at % width), pa.array(total[at])], names=["kind", "a", "b", "n"])

    part = docs.select(F.col("text").cast("binary")).mapInArrow(run, "kind long, a long, b long, n long")
    return part.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def join_gain(table: np.ndarray, sums: np.ndarray, after: np.ndarray, before: np.ndarray, own: float, n: float) -> np.ndarray:
    """Likelihood gained when a word joins each class.

    ``table`` and ``sums`` are class bigrams and totals without the word;
    ``after`` and ``before`` its neighbours by class, ``own`` its pairs with itself.
    """
    corner, own_gain = np.diagonal(table), np.zeros(len(sums))
    for lines, near in ((table, after), (table.T, before)):  # lines[k] meets the neighbour classes in near
        at = np.flatnonzero(near)
        change = xlogx(lines[:, at] + near[at]) - xlogx(lines[:, at])
        own_gain += change.sum(axis=1)
        own_gain[at] -= change[at, np.arange(len(at))]
    own_gain += xlogx(corner + after + before + own) - xlogx(corner)
    return own_gain - 2 * (xlogx(sums + n) - xlogx(sums))


def exchange(pairs: np.ndarray, counts: np.ndarray, rule: ClassRule) -> np.ndarray:
    """Classes of the core words: each in turn moves where the class bigrams become likeliest.

    Ids ``END`` and ``OTHER`` keep classes 0 and 1. Words start dealt by rank.
    """
    size, classes = len(counts), rule.classes + FIRST
    of = np.arange(size)
    of[FIRST:] = FIRST + (np.arange(size - FIRST) % rule.classes)
    pick = np.eye(classes)[of]
    after, before = pairs @ pick, pairs.T @ pick
    table, sums = pick.T @ after, pick.T @ counts
    for _ in range(rule.rounds):
        moved = 0
        for w in range(FIRST, size):
            c, own = of[w], pairs[w, w]
            a, b = after[w].copy(), before[w].copy()
            a[c] -= own
            b[c] -= own
            table[c] -= a
            table[:, c] -= b
            table[c, c] -= own
            sums[c] -= counts[w]
            gain = join_gain(table, sums, a, b, own, counts[w])
            gain[:FIRST] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[c] + 1e-9:
                k = c
            table[k] += a
            table[:, k] += b
            table[k, k] += own
            sums[k] += counts[w]
            if k != c:
                moved += 1
                of[w] = k
                after[:, c] -= pairs[:, w]
                after[:, k] += pairs[:, w]
                before[:, c] -= pairs[w]
                before[:, k] += pairs[w]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    rule: ClassRule
    head: Head
    of: np.ndarray  # class of each head id
    transition: np.ndarray  # log10 by class pair
    emission: np.ndarray  # log10 by head id; 0 for END, not used for OTHER
    base: np.ndarray  # log10 by head id under the plain count model
    known: np.ndarray
    tokens: int  # N
    distinct: int  # V
    other_tokens: int
    other_words: int


def train(docs: DataFrame, rule: ClassRule = ClassRule()) -> tuple[ClassModel, DataFrame]:
    """The model and the table ``word, n`` of all training words.

    Counts cover every text. The driver holds the head, the pairs of the core
    (at most ``core`` squared) and the class table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counted, _ = store(word_counts(docs, rule), "lm-words")
    total = counted.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    tokens, distinct, ends = total["tokens"] or 0, total["distinct"] or 0, total["ends"] or 0
    vocabulary = counted.where(F.col("word").isNotNull())
    # Words met once stand for those not met yet, so they are left to the shared class.
    key = F.when(F.octet_length("word") <= rule.longest, F.col("word")).otherwise(F.unhex(F.sha2("word", 256)))
    able = vocabulary.where("n > 1").select(key.alias("word"), "n")
    top = most_frequent(able, rule.head).toPandas()
    top["word"] = top["word"].map(bytes)
    top = top.sort_values(["n", "word"], ascending=[False, True])
    words = top["word"].tolist()
    other_tokens = tokens - ends - int(top["n"].sum())
    counts = np.concatenate([[ends, other_tokens], top["n"].to_numpy(dtype=float)])
    shared = spark.sparkContext.broadcast(Head(words, rule.longest))

    size = len(counts)
    rank = np.arange(size) - FIRST
    core, placed = min(FIRST + rule.core, size), min(FIRST + rule.placed, size)
    inner = np.where(rank < rule.core, np.arange(size), -1)
    pairs = np.zeros((core, core))
    found = pair_counts(docs, shared, [(inner, inner)]).toPandas()
    pairs[found["a"], found["b"]] = found["n"]
    clustered = FIRST + rule.classes
    of = np.where(rank >= rule.placed, clustered + np.log2(np.maximum(rank, 1) / rule.placed).astype(np.int64), -1)
    of[:core] = exchange(pairs, counts[:core], rule)
    if placed > core:
        near, rest = np.where(inner >= 0, of, -1), np.where((inner < 0) & (rank < rule.placed), np.arange(size), -1)
        pick = np.eye(clustered)[of[:core]]
        table, sums = pick.T @ pairs @ pick, pick.T @ counts[:core]
        rows = pair_counts(docs, shared, [(rest, near), (near, rest)])
        ahead = F.col("kind") == 0
        rows = rows.select("kind", F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("w"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("class"), "n")

        def settle(rows: pd.DataFrame) -> pd.DataFrame:
            words, row = np.unique(rows["w"].to_numpy(), return_inverse=True)
            near = np.zeros((2, len(words), clustered))
            np.add.at(near, (rows["kind"].to_numpy(), row, rows["class"].to_numpy()), rows["n"].to_numpy())
            gains = np.array([join_gain(table, sums, near[0, k], near[1, k], 0.0, counts[w]) for k, w in enumerate(words)])
            return pd.DataFrame({"w": words, "class": FIRST + gains[:, FIRST:].argmax(axis=1)})

        # A group holds the class counts of its share of the placed words, whose number is fixed.
        chosen = rows.groupBy((F.col("w") % 64).alias("part")).applyInPandas(settle, "w long, class long").toPandas()
        of[chosen["w"]] = chosen["class"]
        of[of < 0] = FIRST + int(sums[FIRST:].argmin())
    classes = int(max(of.max() + 1, clustered))
    bigrams = np.zeros((classes, classes))
    found = pair_counts(docs, shared, [(of, of)]).toPandas()
    bigrams[found["a"], found["b"]] = found["n"]

    mass = np.bincount(of, weights=counts, minlength=classes)
    plain = (mass + rule.smooth) / (mass.sum() + rule.smooth * classes)
    leaving, kinds = bigrams.sum(axis=1, keepdims=True), (bigrams > 0).sum(axis=1, keepdims=True)
    kinds = np.maximum(kinds, 1)
    transition = np.log10((bigrams + kinds * plain[None, :]) / (leaving + kinds))
    members = np.bincount(of, minlength=classes)
    emission = np.log10((counts + rule.smooth) / (mass[of] + rule.smooth * members[of]))
    emission[END] = 0.0
    base = np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))
    model = ClassModel(rule, Head(words, rule.longest), of, transition, emission, base, counts > 0, tokens, distinct, other_tokens, distinct - (ends > 0) - len(words))
    return model, vocabulary


SCHEMA = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, others array<struct<word:binary,n:long>>"


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text.

    ``docs`` has ``doc_id, held_out, text``. Head words and class transitions are
    scored where the text is; words outside the head meet their counts in a join.

    Null and empty texts are their end alone. Null and repeated ids, repeated
    rows: each row is scored by itself. Other columns are ignored. Nothing
    learned: uniform smoothing alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    inner = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            rows = []
            for text in _texts(batch, 3):
                words = words_of(text)
                ids = m.head.sequence(words)
                c, own = m.of[ids], ids[1:]
                head = own[own != OTHER]
                others = Counter(words[k] for k in np.flatnonzero(own == OTHER).tolist())
                total = m.transition[c[:-1], c[1:]].sum() + m.emission[head].sum()
                rows.append((len(own), int(m.known[head].sum()), float(m.base[head].sum()), float(total), [{"word": w, "n": n} for w, n in others.items()]))
            n_tokens, n_known, base, total, others = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(others, inner)],
                names=["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "others"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "held_out", F.col("text").cast("binary"))
    parts, _ = store(numbered.mapInArrow(run, SCHEMA), "lm-scores")  # stored, so that row_id stays what it is
    words = parts.select("row_id", F.explode("others").alias("o")).select("row_id", "o.word", F.col("o.n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    met = words.join(vocabulary, "word", "left").groupBy("row_id").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))).alias("base"),
        F.sum(F.col("times") * F.log10((c + F.lit(model.rule.smooth)) / F.lit(model.other_tokens + model.rule.smooth * (model.other_words + 1)))).alias("own"),
    )
    done = parts.drop("others").join(met, "row_id", "left")
    total = F.col("score") + F.coalesce("own", F.lit(0.0))
    return done.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
