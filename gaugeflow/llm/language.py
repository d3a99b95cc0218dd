"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unit

UNDETERMINED = "und"
MOST_LANGUAGES = 1000  # rows of the per-language count that the driver takes


@dataclass(frozen=True)
class LanguageRule:
    """``rows`` bounds the labelled documents that the classifier is fitted on, ``calibrate`` the share of them kept for the temperature."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    rows: int = 4000
    calibrate: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    seed: int = 11


def ngram_buckets(text: str, rule: LanguageRule) -> np.ndarray:
    """A bucket for every character n-gram of the whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    found = []
    for order in rule.orders:
        if len(c) < order:
            break
        h = np.full(len(c) - order + 1, order, dtype=np.uint64)
        for j in range(order):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ c[j:len(c) - order + 1 + j]
        h *= np.uint64(0xD6E8FEB86659FD93)
        found.append((h >> np.uint64(40)).astype(np.int64) & (rule.buckets - 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def term_counts(text: str, rule: LanguageRule) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(ngram_buckets(text, rule), minlength=rule.buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class LanguageModel:
    rule: LanguageRule
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def probabilities(self, text: str) -> np.ndarray:
        at, counts = term_counts(text, self.rule)
        return softmax(weigh(at, counts, self.idf) @ self.weights[at] / self.temperature)


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, rule: LanguageRule) -> tuple[np.ndarray, int]:
    """In how many of all documents each bucket occurs; a vector of fixed length, summed by Spark."""

    def run(batches):
        seen, n = np.zeros(rule.buckets, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen[np.unique(ngram_buckets(text, rule))] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], n)})

    rows = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(rule.buckets), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, n


def labelled_sample(docs: DataFrame, rule: LanguageRule) -> tuple[pd.DataFrame, list[str]]:
    """About ``rule.rows`` labelled documents, as even over languages as they allow, as term counts of their whole texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return pd.DataFrame(), languages
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, rule.rows / len(languages) / sizes[name]))).otherwise(share)
    order = unit(F.lit(rule.seed), F.col("doc_id"), F.xxhash64("text"))
    chosen = known.where(order < share).select(order.alias("draw"), "lang", "text")

    def run(batches):
        for batch in batches:
            pairs = [term_counts(t, rule) for t in batch["text"]]
            yield pd.DataFrame({"draw": batch["draw"], "lang": batch["lang"], "at": [a for a, _ in pairs], "counts": [c for _, c in pairs]})

    return chosen.mapInPandas(run, "draw double, lang string, at array<int>, counts array<int>").toPandas(), languages


def fit_ftrl(xs: list, ys: list[int], k: int, rule: LanguageRule) -> np.ndarray:
    """Follow the regularised leader: per-coordinate rates, weights that are zero until a sum passes ``l1``."""
    z, n = np.zeros((rule.buckets, k)), np.zeros((rule.buckets, k))

    def current(at):
        zz = z[at]
        return np.where(np.abs(zz) > rule.l1, -(zz - np.sign(zz) * rule.l1) / ((rule.beta + np.sqrt(n[at])) / rule.alpha + rule.l2), 0.0)

    for _ in range(rule.epochs):
        for (at, x), y in zip(xs, ys):
            w = current(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / rule.alpha * w
    return current(np.arange(rule.buckets))


def fit_temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(ys):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-300)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, rule: LanguageRule = LanguageRule()) -> LanguageModel:
    """Learn from ``text`` and non-null ``lang``; statistics over all rows, weights from a bounded sample."""
    small_batches(docs.sparkSession)
    sample, languages = labelled_sample(docs, rule)
    frequency, n = document_frequencies(docs, rule)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    weights, temperature = np.zeros((rule.buckets, max(1, len(languages)))), 1.0
    if len(sample):
        sample = sample.sort_values("draw", kind="stable")
        xs = [(np.asarray(a), weigh(np.asarray(a), np.asarray(c), idf)) for a, c in zip(sample["at"], sample["counts"])]
        ys = np.array([languages.index(v) for v in sample["lang"]])
        kept = int(len(xs) * rule.calibrate)
        order = np.random.default_rng(rule.seed).permutation(len(xs))
        fit, held = order[kept:], order[:kept]
        weights = fit_ftrl([xs[i] for i in fit], [int(ys[i]) for i in fit], len(languages), rule)
        if kept:
            temperature = fit_temperature(np.array([xs[i][1] @ weights[xs[i][0]] for i in held]), ys[held])
    return LanguageModel(rule, languages, idf.astype(np.float32), weights.astype(np.float32), temperature)


def predict(model: LanguageModel, spark) -> "callable":
    """A column function: text -> struct of language and probability."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        m, names, scores = shared.value, [], []
        for text in texts:
            if not text or not m.languages or not any(map(str.isalpha, text)):
                names.append(UNDETERMINED)
                scores.append(0.0)
            else:
                p = m.probabilities(text)
                names.append(m.languages[int(p.argmax())])
                scores.append(float(p.max()))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run.asNondeterministic()  # one evaluation, wherever a filter stands


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``row`` (the document's columns as a struct), ``lang_pred, score``.

    Null text, or text without a letter: ``und`` with score 0; so is everything
    if no language was learned. Whole texts are read, however long. Rows keep
    all their columns, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    text: Column = F.col("text")
    guess = predict(model, docs.sparkSession)(text)
    return docs.select(F.struct("*").alias("row"), guess.alias("guess")).select("row", "guess.lang_pred", "guess.score")
