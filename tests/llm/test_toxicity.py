import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from gaugeflow.llm.toxicity import ToxicModel, ToxicRule, _codes, assess, fit_sigmoid, fit_svm, kernel, train, windows

INSULTS = "brakzum wostel gorfin".split()


def kernel_by_subsequences(s, t, order, decay):
    def spans(x):
        out = {}
        for c in combinations(range(len(x)), order):
            out.setdefault("".join(x[i] for i in c), []).append(c[-1] - c[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(decay ** (x + y) for u in a if u in b for x in a[u] for y in b[u])


def test_kernel_equals_its_definition():
    draw = random.Random(1)
    words = ["".join(draw.choices("abcé", k=draw.randint(1, 7))) for _ in range(40)]
    pairs = list(zip(words, reversed(words)))
    for order in (1, 2, 3, 4):
        got = kernel(_codes([a for a, _ in pairs], 7, -1), _codes([b for _, b in pairs], 7, -2), order, 0.6)
        assert got == pytest.approx([kernel_by_subsequences(a, b, order, 0.6) for a, b in pairs], rel=1e-4, abs=1e-6)


def test_windows_join_what_is_spelled_out():
    found = windows(b"You are I-D.I-O*T and i d o l !! gone")
    assert {b"you", b"are", b"idiot", b"idol"} <= found
    assert windows(b"") == set() and windows(b"12 !! \n") == set()


@pytest.fixture(scope="module")
def corpus(spark, prose):
    draw, rows = random.Random(9), []
    for k in range(900):
        words, toxic = prose(k, draw.randint(1, 80)).split(), k % 4 == 0
        if toxic:
            for _ in range(draw.randint(1, 3)):
                word = draw.choice(INSULTS)
                at = draw.randrange(1, len(word))
                words.insert(draw.randint(0, len(words)), draw.choice([word, word, word.upper(), word[:at] + "x" + word[at:], word + "##", word[:at] + "-" + word[at:], " ".join(word)]))
        rows.append((k, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_quality(spark, corpus):
    learn, held = corpus.where("doc_id % 5 <> 1"), corpus.where("doc_id % 5 = 1")
    model = train(learn.select("doc_id", "text"), learn.select("doc_id", "toxic"))
    assert set(INSULTS) <= set(model.landmarks[:6])
    rows = assess(held, model).select("row.toxic", "score", "predicted").collect()
    caught = np.mean([r.predicted for r in rows if r.toxic])
    blamed = np.mean([r.predicted for r in rows if not r.toxic])
    assert caught > 0.9 and blamed < 0.05 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    gapped = spark.createDataFrame([(1, "kalo wo.st.el mi"), (2, "w o s t e l"), (3, "wosxtel renka"), (4, "kalo miren tosul vizan")], "doc_id long, text string")
    assert [r.predicted for r in assess(gapped, model).orderBy("row.doc_id").collect()] == [1, 1, 1, 0]


def test_machine_and_sigmoid():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((400, 3))
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > 0.3, 1, -1)
    w, b = fit_svm(x, y, ToxicRule(cost=10.0))
    assert (np.sign(x @ w + b) == y).mean() > 0.98
    margin = draw.standard_normal(4000) * 3
    label = np.where(draw.random(4000) < 1 / (1 + np.exp(-(1.5 * margin - 0.7))), 1, -1)
    slope, shift = fit_sigmoid(margin, label, np.ones(4000))
    assert slope == pytest.approx(1.5, rel=0.15) and shift == pytest.approx(-0.7, abs=0.2)


def test_memory_of_words_changes_nothing(prose):
    texts = [prose(k, 50).encode() + b" brakzumm wos!tel" for k in range(30)]
    large, small = (ToxicModel(ToxicRule(memo=m), INSULTS, np.eye(3)) for m in (10**6, 1))
    assert np.array_equal(large.pooled(texts), np.vstack([small.pooled([t]) for t in texts]))


def test_defined_cases(spark, messy, corpus):
    model = train(corpus.select("doc_id", "text"), corpus.select("doc_id", "toxic"))
    rows = assess(messy, model).collect()
    blank = {r.score for r in rows if r.row.doc_id in (4, 5, 6)}
    assert len(rows) == messy.count() and len(blank) == 1 and all(r.score < 0.3 for r in rows)
    assert assess(messy, model).select("row.*").columns == messy.columns and assess(messy.limit(0), model).count() == 0
    labels = corpus.select("doc_id", "toxic")
    for bad in (labels.limit(0), labels.where("toxic = 1"), labels.selectExpr("doc_id", "cast(null as int) as toxic")):
        assert {r.score for r in assess(messy, train(corpus.select("doc_id", "text"), bad)).collect()} == {0.0}
    twice = labels.unionByName(labels).unionByName(labels.selectExpr("cast(null as long) as doc_id", "1 as toxic"))
    again = train(corpus.select("doc_id", "text"), twice)
    assert again.landmarks == model.landmarks


def test_query(spark):
    from gaugeflow.llm.queries import QUERIES

    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([p for t, p in held if t]) > 0.5 and np.mean([p for t, p in held if not t]) < 0.15
