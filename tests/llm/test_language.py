import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeflow.llm.language import LanguageRule, document_frequencies, fit_ftrl, fit_temperature, identify, labelled_sample, ngram_buckets, softmax, train

PARTS = {"aa": "ka lo mi ren tos".split(), "bb": "ul vi zan per dol".split(), "cc": "éça öst ñil bre nik".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    draw, rows = random.Random(5), []
    for k in range(600):
        lang = draw.choice(["aa"] * 5 + ["bb", "cc"])
        words = ["".join(draw.choices(PARTS[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(1, 60))]
        rows.append((k, " ".join(words), None if k % 17 == 0 else lang, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy(corpus):
    held = "doc_id % 3 = 1"
    model = train(corpus.where(f"not ({held})").select("doc_id", "text", "lang"))
    got = identify(corpus.where(held), model).select("row.truth", "lang_pred", "score").collect()
    right = [r.truth == r.lang_pred for r in got]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert abs(np.mean([r.score for r in got]) - np.mean(right)) < 0.1


def test_labels_alone_teach(corpus):
    """Names of the languages, ids and rows without a label do not enter."""
    model = train(corpus.select("doc_id", "text", "lang"))
    renamed = train(corpus.selectExpr("doc_id", "text", "translate(lang, 'abc', 'xyz') as lang"))
    assert model.languages == ["aa", "bb", "cc"] and renamed.languages == ["xx", "yy", "zz"]
    assert np.allclose(model.weights, renamed.weights, atol=1e-5) and model.temperature == pytest.approx(renamed.temperature, rel=1e-3)


def test_frequencies_cover_all_rows(corpus):
    rule = LanguageRule(buckets=1 << 10)
    want, n = Counter(), 0
    for r in corpus.collect():
        want.update(set(ngram_buckets(r.text, rule).tolist()))
        n += 1
    got, m = document_frequencies(corpus, rule)
    assert m == n and {k: int(v) for k, v in enumerate(got) if v} == dict(want)


def test_sample_is_bounded_and_even(corpus):
    sample, languages = labelled_sample(corpus, LanguageRule(rows=60))
    sizes = Counter(sample["lang"])
    assert languages == ["aa", "bb", "cc"] and 30 < len(sample) < 90 and all(8 <= sizes[x] <= 40 for x in languages)


def test_ngrams_are_those_of_the_whole_text():
    rule = LanguageRule()
    text = "abcde𝒳" * 5000
    assert len(ngram_buckets(text, rule)) == sum(len(text) - k + 1 for k in rule.orders)
    assert len(ngram_buckets("a", rule)) == 1 and len(ngram_buckets("", rule)) == 0
    assert np.array_equal(ngram_buckets("ABC", rule), ngram_buckets("abc", rule))


def test_ftrl_is_sparse_and_separates():
    draw = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(400):
        y = int(draw.integers(2))
        xs.append((np.array([y, 2, 3 + int(draw.integers(20))]), np.array([1.0, 0.5, 0.5])))
        ys.append(y)
    w = fit_ftrl(xs, ys, 2, LanguageRule(buckets=64, l1=0.8))
    assert (w == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    heavier = fit_ftrl(xs, ys, 2, LanguageRule(buckets=64, l1=0.8, l2=5.0))
    assert np.abs(heavier).max() < np.abs(w).max()


def test_temperature_minimises_the_loss():
    draw = np.random.default_rng(1)
    logits = draw.standard_normal((3000, 3)) * 2
    ys = np.array([draw.choice(3, p=p) for p in softmax(logits / 2.5)])
    assert fit_temperature(logits, ys) == pytest.approx(2.5, rel=0.15)
    assert fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_defined_cases(spark, messy, corpus):
    model = train(corpus.select("doc_id", "text", "lang"))
    got = identify(messy, model)
    rows = got.collect()
    assert len(rows) == messy.count() and rows[0].row.key == "k"
    for r in rows:
        if r.row.doc_id in (4, 5, 6, 8):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages and 0 < r.score <= 1
    assert got.select("row.*").columns == messy.columns and identify(messy.limit(0), model).count() == 0
    nothing = train(messy.select("doc_id", "text", "lang").limit(0))
    assert {r.lang_pred for r in identify(messy, nothing).collect()} == {"und"}


def test_query(spark):
    from gaugeflow.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]) > 0.97
