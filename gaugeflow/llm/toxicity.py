"""Toxic texts: a support vector machine over a gapped subsequence kernel with Nyström landmarks."""

from __future__ import annotations

import re
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unit

KEEP = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
DROP = bytes(b for b in range(128) if not (chr(b).isalpha() or chr(b).isspace()))
SPELLED = re.compile(rb"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")


@dataclass(frozen=True)
class ToxicRule:
    """``rows`` bounds the labelled documents that the classifier is fitted on.

    A window is a word without its non-letters, or a run of very short words put
    together; windows over ``span`` letters are cut with an overlap of half.
    """

    rows: int = 12_000
    landmarks: int = 128
    order: int = 3
    decay: float = 0.6
    power: int = 4
    gate: float = 0.6
    reach: int = 3
    least: float = 0.01
    span: int = 24
    calibrate: float = 0.3
    cost: float = 1.0
    epochs: int = 30
    cut: float = 0.3
    seed: int = 23
    memo: int = 400_000


def windows(raw: bytes) -> set[bytes]:
    """Distinct folded words of a text and its spelled-out runs (``i d i o t``)."""
    folded = raw.translate(KEEP, DROP)
    found = set(folded.split())
    for run in SPELLED.findall(folded):
        found.add(b"".join(run.split()))
    return found


def pieces(window: bytes, span: int) -> list[str]:
    word = window.decode("utf-8", "replace")
    if not word.isascii():
        word = "".join(filter(str.isalpha, word.lower()))
    if len(word) <= span:
        return [word]
    return [word[k:k + span] for k in range(0, len(word) - span // 2, span // 2)]


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32)
    codes = flat.reshape(len(words), width).astype(np.int64)
    return np.where(codes == 0, pad, codes)


def _pair_bits(codes: np.ndarray, reach: int) -> np.ndarray:
    """256 bits a row: letter pairs at most ``reach`` letters apart, in order."""
    bits, rows = np.zeros((len(codes), 256), dtype=bool), np.arange(len(codes))
    for d in range(1, reach + 1):
        for i in range(codes.shape[1] - d):
            a, b = codes[:, i], codes[:, i + d]
            live = (a >= 0) & (b >= 0)
            bits[rows[live], ((a[live] * 0x9E3779B1 + b[live] * 0x85EBCA77) >> 7) & 255] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def kernel(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Subsequences of ``order`` letters common to the rows of ``s`` and ``t``, each weighed by ``decay`` per letter spanned.

    ``s`` is padded with -1 and ``t`` with -2. The usual recursion over both
    strings runs once for all pairs.
    """
    pairs, n, m = len(s), s.shape[1], t.shape[1]
    below = np.ones((m + 1, n + 1, pairs), dtype=np.float32)
    weight = np.float32(decay * decay)
    decay = np.float32(decay)
    for q in range(1, order + 1):
        table = np.zeros_like(below)
        total = np.zeros(pairs, dtype=np.float32)
        for i in range(1, n + 1):
            run = np.zeros(pairs, dtype=np.float32)
            same = (t == s[:, i - 1:i]).T * weight
            for j in range(1, m + 1):
                step = same[j - 1] * below[j - 1, i - 1]
                if q == order:
                    total += step
                else:
                    run = decay * run + step
                    table[j, i] = decay * table[j, i - 1] + run
        below = table
    return total


def self_kernel(codes: np.ndarray, rule: ToxicRule) -> np.ndarray:
    other = np.where(codes < 0, -2, codes)
    return kernel(codes, other, rule.order, rule.decay)


@dataclass
class ToxicModel:
    rule: ToxicRule
    landmarks: list[str]
    root: np.ndarray  # K^(-1/2) of the landmarks
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        self.codes = _codes(self.landmarks, max([len(x) for x in self.landmarks] or [1]), -2)
        self.bits = _pair_bits(self.codes, 1)
        self.need = np.maximum(1, np.ceil(self.rule.gate * np.bitwise_count(self.bits).sum(axis=1)))
        self.norms = self_kernel(np.where(self.codes < 0, -1, self.codes), self.rule)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def similar(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, landmark and kernel of the pairs that pass the gate.

        A word passes if it has the landmark's neighbouring letters in order and
        near each other, for a share ``rule.gate`` of them. The kernel is
        normalised and raised to ``rule.power``.
        """
        codes = _codes(words, max(len(w) for w in words), -1)
        bits = _pair_bits(codes, self.rule.reach)
        shared = np.bitwise_count(bits[:, None, :] & self.bits[None, :, :]).sum(axis=2, dtype=np.int64)
        at, to = np.nonzero(shared >= self.need[None, :])
        out, norms = np.zeros(len(at)), np.zeros(len(words))
        lengths = (codes >= 0).sum(1)
        for low, high in ((0, 7), (7, 11), (11, 1 << 30)):
            chosen = np.flatnonzero((lengths[at] > low) & (lengths[at] <= high))
            if not len(chosen):
                continue
            one = np.unique(at[chosen])
            width = lengths[one].max()
            norms[one] = self_kernel(codes[one, :width], self.rule)
            for part in np.array_split(chosen, len(chosen) // 2048 + 1):  # fits the processor's cache
                s, t = codes[at[part], :width], self.codes[to[part]]
                norm = np.sqrt(norms[at[part]] * self.norms[to[part]])
                out[part] = np.where(norm > 0, kernel(s, t, self.rule.order, self.rule.decay) / np.maximum(norm, 1e-30), 0.0) ** self.rule.power
        return at, to, out

    def learn(self, unknown: list[bytes]) -> None:
        words, owner = [], []
        for w in unknown:
            self.memo[w] = None
            for p in pieces(w, self.rule.span):
                if len(p) >= self.rule.order:
                    words.append(p)
                    owner.append(w)
        for k in range(0, len(words), 4096):
            at, to, value = self.similar(words[k:k + 4096])
            near = value > self.rule.least
            for i, j, v in zip(at[near].tolist(), to[near].tolist(), value[near].tolist()):
                row = self.memo[owner[k + i]] = self.memo[owner[k + i]] or {}
                row[j] = max(v, row.get(j, 0.0))

    def pooled(self, texts: list[bytes | None]) -> np.ndarray:
        """For each text and landmark the kernel of the window that is nearest to it."""
        out = np.zeros((len(texts), len(self.landmarks)))
        if not self.landmarks:
            return out
        for start in range(0, len(texts), 200):
            if len(self.memo) > self.rule.memo:
                self.memo.clear()
            found = [windows(t) if t else () for t in texts[start:start + 200]]
            memo = self.memo
            unknown = {w for ws in found for w in ws if w not in memo}
            if unknown:
                self.learn(list(unknown))
            for n, ws in enumerate(found, start):
                for row in filter(None, map(memo.__getitem__, ws)):
                    for j, v in row.items():
                        if v > out[n, j]:
                            out[n, j] = v
        return out

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.root @ self.weights + self.bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(self.pooled(texts)) + self.shift, -50, 50)))


def pick_landmarks(words: DataFrame, toxic: int, clean: int, rule: ToxicRule) -> list[str]:
    """The words (``word, toxic, clean``: documents with it) that toxic documents have more often, by log likelihood ratio.

    Every word is rated by its counts; equal ratios go by the word.
    """
    if not toxic or not clean:
        return []
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def term(k, n, p):
        return k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))

    both = (a + b) / float(toxic + clean)
    gain = term(a, float(toxic), a / toxic) + term(b, float(clean), b / clean) - term(a, float(toxic), both) - term(b, float(clean), both)
    ahead = words.where(a / toxic > b / clean).select("word", gain.alias("gain")).where("gain > 0")
    return [r["word"] for r in ahead.orderBy(F.desc("gain"), "word").limit(rule.landmarks).collect()]


def fit_svm(x: np.ndarray, y: np.ndarray, rule: ToxicRule) -> tuple[np.ndarray, float]:
    """Linear machine with hinge loss by dual coordinate ascent; the last feature is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    top = rule.cost / (2 * np.maximum(share, 1e-9))
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    draw = np.random.default_rng(rule.seed)
    for _ in range(rule.epochs):
        for i in draw.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by damped Newton steps."""
    if not len(y) or len(set(y)) < 2:
        return 1.0, 0.0
    x, target = np.column_stack([margin, np.ones_like(margin)]), (y > 0).astype(float)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step / max(1.0, np.abs(step).max())
    return float(max(beta[0], 1e-3)), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, rule: ToxicRule) -> tuple[DataFrame, dict[int, float]]:
    """About ``rule.rows`` labelled documents, half of each class where there are as many, and the share drawn of each class.

    A document labelled more than once is toxic if any label says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    shares = {y: min(1.0, rule.rows / 2 / n) for y, n in sizes.items()}
    share = F.when(F.col("toxic") == 1, F.lit(shares.get(1, 0.0))).when(F.col("toxic") == 0, F.lit(shares.get(0, 0.0))).otherwise(F.lit(0.0))
    # At most about ``rule.rows`` rows of two numbers.
    drawn = known.where(unit(F.lit(rule.seed), F.col("doc_id")) < share)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id"), shares


def train(docs: DataFrame, labels: DataFrame, rule: ToxicRule = ToxicRule()) -> ToxicModel:
    """Learn from the texts of ``docs`` that ``labels`` marks; without both classes every score is 0."""
    spark = docs.sparkSession
    small_batches(spark)
    sample, shares = labelled_sample(docs, labels, rule)

    def count(batches):
        seen, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"]):
                n[y] += 1
                seen[y].update({p for w in windows(text or b"") for p in pieces(w, rule.span) if len(p) >= rule.order})
        names = list(seen[0] | seen[1])
        yield pd.DataFrame({"word": names + [""], "toxic": [seen[1][w] for w in names] + [n[1]], "clean": [seen[0][w] for w in names] + [n[0]]})

    words = sample.mapInPandas(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    row = words.where("word = ''").collect()
    toxic, clean = (row[0]["toxic"], row[0]["clean"]) if row else (0, 0)
    marks = pick_landmarks(words.where("word <> ''"), toxic, clean, rule)
    model = ToxicModel(rule, marks, np.eye(len(marks)))
    if not marks:
        return model
    at, to, value = model.similar(marks)
    gram = np.zeros((len(marks), len(marks)))
    gram[at, to] = value
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(marks)))
    model.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    shared = spark.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "k": list(shared.value.pooled(batch["text"].tolist()))})

    rows = sample.mapInPandas(features, "doc_id long, toxic int, k array<double>").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(rows["k"].tolist()) @ model.root, np.where(rows["toxic"].to_numpy() == 1, 1, -1)
    order = np.random.default_rng(rule.seed).permutation(len(y))
    held, fit = np.split(order, [int(len(order) * rule.calibrate)])
    if len(set(y[fit])) < 2:
        return model
    model.weights, model.bias = fit_svm(x[fit], y[fit], rule)
    weight = np.where(y > 0, 1 / max(shares.get(1, 1.0), 1e-12), 1 / max(shares.get(0, 1.0), 1e-12))
    model.slope, model.shift = fit_sigmoid(x[held] @ model.weights + model.bias, y[held], weight[held] / weight[held].mean())
    return model


def assess(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``row`` (the document's columns as a struct), ``score`` in [0, 1], ``predicted``.

    Null and empty texts are scored as texts without a window. Whole texts are
    read. Rows keep all their columns, whatever their names; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()), dtype=float)

    score = run.asNondeterministic()(F.col("text").cast("binary"))
    found = docs.select(F.struct("*").alias("row"), score.alias("score"))
    return found.select("row", "score", (F.col("score") >= model.rule.cut).cast("int").alias("predicted"))
