import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeflow.llm.lm import FIRST, ClassRule, exchange, join_gain, most_frequent, score, train, words_of, xlogx


def likelihood(pairs, counts, of, classes):
    pick = np.eye(classes)[of]
    return xlogx(pick.T @ pairs @ pick).sum() - 2 * xlogx(pick.T @ counts).sum()


def test_join_gain_is_the_change_of_likelihood():
    draw = np.random.default_rng(3)
    pairs = draw.integers(0, 6, (10, 10)).astype(float)
    counts = pairs.sum(axis=1)
    of, w = np.array([0, 1, 2, 2, 3, 3, 4, 4, 2, 3]), 7
    others = np.delete(np.arange(10), w)
    pick = np.eye(5)[of]
    less = pick[others].T @ pairs[np.ix_(others, others)] @ pick[others], pick[others].T @ counts[others]
    after, before = pairs[w, others] @ pick[others], pairs[others, w] @ pick[others]
    gain = join_gain(*less, after, before, pairs[w, w], counts[w])
    for k in range(5):
        moved = of.copy()
        moved[w] = k
        assert gain[k] - gain[0] == pytest.approx(likelihood(pairs, counts, moved, 5) - likelihood(pairs, counts, np.where(np.arange(10) == w, 0, of), 5))


def test_exchange_only_improves():
    draw = np.random.default_rng(4)
    for seed in range(5):
        pairs = draw.poisson(1.0, (40, 40)).astype(float)
        counts = pairs.sum(axis=1) + 1
        start = np.concatenate([[0, 1], FIRST + np.arange(38) % 4])
        last = likelihood(pairs, counts, start, 6)
        for rounds in (1, 2, 6):
            of = exchange(pairs, counts, ClassRule(classes=4, rounds=rounds))
            now = likelihood(pairs, counts, of, 6)
            assert now >= last - 1e-9 and of[0] == 0 and of[1] == 1 and of[2:].min() >= FIRST
            last = now


def test_exchange_finds_planted_classes():
    """Words that follow each other in a cycle of three kinds end up with their kind."""
    draw = np.random.default_rng(5)
    kind = np.arange(30) % 3
    draw.shuffle(kind)
    pairs = np.zeros((32, 32))
    for a in range(30):
        for b in range(30):
            if kind[b] == (kind[a] + 1) % 3:
                pairs[a + 2, b + 2] = draw.poisson(20)
    of = exchange(pairs, pairs.sum(axis=1), ClassRule(classes=3, rounds=10))[2:]
    assert all(len(set(of[kind == k])) == 1 for k in range(3)) and len(set(of)) == 3


def plain(docs):
    """Counts, and per text the tokens and the base score by its formula."""
    counts = Counter()
    for _, text, held in docs:
        if not held:
            counts.update([*words_of((text or "").encode()), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text, _ in docs:
        tokens = [*words_of((text or "").encode()), None]
        out.append((d, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)))
    return out


@pytest.fixture(scope="module")
def corpus(prose):
    return [(k, prose(k, k % 60), k % 5 == 1) for k in range(300)] + [(300, None, False), (301, "", True), (302, "x" * 5000 + " " + "x" * 5000, True), (302, "x" * 5000, False), (302, "x" * 5000, False)]


@pytest.mark.parametrize("rule", [ClassRule(), ClassRule(classes=5, core=20, placed=60, head=150, longest=6, flush=50), ClassRule(classes=3, core=1, placed=1, head=1)])
def test_counts_and_base_score(spark, corpus, rule):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, held_out boolean").repartition(4)
    model, vocabulary = train(docs.where("not held_out"), rule)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in score(docs, model, vocabulary).collect())
    want = sorted(plain(corpus))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-6)


def test_probabilities_sum_to_one(spark, corpus):
    """Over all learned words and one unknown, after any word."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string, held_out boolean")
    rule = ClassRule(classes=5, core=20, placed=60, head=150)
    model, vocabulary = train(docs.where("not held_out"), rule)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    for k in range(2, model.transition.shape[0]):
        if (model.of == k).any():
            assert (10 ** model.emission[model.of == k]).sum() == pytest.approx(1)
    words = [bytes(r.word) for r in vocabulary.collect()]
    tests = [(k, w.decode()) for k, w in enumerate(words)] + [(len(words), "never-seen"), (len(words) + 1, "")]
    frame = spark.createDataFrame([(k, t, True) for k, t in tests], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in score(frame, model, vocabulary).collect()}
    ends = dict(zip(range(len(tests)), [model.transition[model.of[model.head.ids.get(t.encode(), 1)], 0] for _, t in tests]))
    total = sum(10 ** (got[k] - ends[k]) for k in range(len(words) + 1)) + 10 ** got[len(words) + 1]
    assert total == pytest.approx(1, abs=1e-6)


def test_better_than_counts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from gaugeflow.llm.queries import QUERIES

    rows = QUERIES["op2_class_lm"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_defined_cases(spark, messy):
    docs = messy.selectExpr("doc_id", "text", "false as held_out", "score", "key")
    model, vocabulary = train(docs)
    rows = score(docs, model, vocabulary).collect()
    assert len(rows) == messy.count() and all(r.n_tokens == 1 for r in rows if r.doc_id in (4, 5, 6)) and all(r.score < 0 and r.perplexity > 1 for r in rows)
    assert score(docs.limit(0), model, vocabulary).count() == 0
    nothing, none = train(docs.limit(0))
    rows = score(docs, nothing, none).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)


def test_head_is_exact(spark):
    """Whatever its size, the head is full and no word outside it is more frequent."""
    words = [(b"w%d" % k, 2 + (k % 7 == 0) + 50 * (k % 91 == 0)) for k in range(1000)]
    frame = spark.createDataFrame(words, "word binary, n long")
    for most in (0, 1, 11, 100, 150, 151, 700, 999, 1000, 2000):
        got = sorted((r.n for r in most_frequent(frame, most).collect()), reverse=True)
        assert got == sorted((n for _, n in words), reverse=True)[:most]


def test_rare_head_words_take_the_class_of_their_neighbours(spark):
    """Words far beyond rank 16384, half of them between ``la`` and ``lb``, half between ``ra`` and ``rb``; long ones too."""
    draw = random.Random(7)
    names = ["rl"[k % 2] + str(k) + "x" * (100 if k > 16_900 else 0) for k in range(17_000)]
    texts = [f"{name[0]}a {name} {name[0]}b" for k, name in enumerate(names) for _ in range(3 if k < 16_800 else 2)]
    texts += ["la lb la lb", "ra rb ra rb"] * 5000
    draw.shuffle(texts)
    docs = spark.createDataFrame([(k, " ".join(texts[k::400]), False) for k in range(400)], "doc_id long, text string, held_out boolean")
    model, _ = train(docs, ClassRule(classes=4, core=4))
    of = {name: int(model.of[model.head.sequence([name.encode()])[1]]) for name in names[16_800:]}
    lefts, rights = ({c for name, c in of.items() if name[0] == side} for side in "lr")
    assert min(of.values()) >= FIRST and not lefts & rights
