import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm.fingerprints import SketchRule, containment, distinct_count, fingerprints, merged, resemblance, sketch


def shingle_set(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_estimates(spark, prose):
    pairs = [(prose("a", 3000), prose("a", 3000)), (prose("a", 4000), prose("a", 2000)), (prose("a", 900), prose("b", 900)), ("one two three", "one two three"), ("", ""), ("", "x"), (prose("c", 60), prose("c", 50)), (None, "")]
    rule = SketchRule(k=256)
    a, b = sketch(F.col("a"), rule), sketch(F.col("b"), rule)
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", a.alias("x"), b.alias("y"))
    got = frame.select("a", "b", resemblance(F.col("x"), F.col("y"), 256).alias("j"), containment(F.col("y"), F.col("x"), 256).alias("c"), distinct_count(F.col("x"), 256).alias("n"), F.size("x").alias("size")).collect()
    for r in got:
        x, y = shingle_set(r.a), shingle_set(r.b)
        assert r.j == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0.1)
        assert r.c == pytest.approx(len(x & y) / len(y) if y else 1.0, abs=0.15)
        assert r.n == pytest.approx(len(x), rel=0.2) and (len(x) > 256 or r.n == len(x)) and r.size == min(len(x), 256)


def test_sketches_of_parts_merge(spark, prose):
    rule = SketchRule(k=64)
    words = prose("m", 1000).split()
    left, right = " ".join(words[:504]), " ".join(words[500:])  # four words overlap, so no shingle is lost or new
    frame = spark.createDataFrame([(left, right, " ".join(words))], "a string, b string, c string")
    row = frame.select(merged(sketch(F.col("a"), rule), sketch(F.col("b"), rule), 64).alias("m"), sketch(F.col("c"), rule).alias("w")).first()
    assert row.m == row.w and len(row.w) == 64


@pytest.mark.parametrize("rule", [SketchRule(), SketchRule(chunk=7), SketchRule(chunk=1), SketchRule(chunk=1, most_chunks=70)])
def test_next_and_edited(spark, prose, rule):
    ids = [k * k - 50 for k in range(150)]
    texts = {i: ("" if i % 11 == 0 else prose(i, i % 90 + 1) + "é𝒳") for i in ids}
    docs = spark.createDataFrame([(i, texts[i], "x") for i in reversed(ids)], "doc_id long, text string, chunk string").repartition(5)
    got = {r.doc_id: r for r in fingerprints(docs, rule).collect()}
    order = sorted(ids)
    assert sorted(got) == order
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        assert got[i].n_chars == len(text)
        assert got[i].edited == text[:len(text) - half] + following[:half]
        assert got[i].next_sketch == got[order[(k + 1) % len(order)]].own_sketch


def test_messy_rows(spark, messy):
    rows = fingerprints(messy).collect()
    assert len(rows) == messy.count()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.own_sketch) == r.own_sketch
    assert by_text[""] == [] and len(by_text["one two"]) == 1
    assert fingerprints(messy.limit(0)).count() == 0
    alone = fingerprints(messy.where("doc_id = 7")).first()
    assert alone.edited == "one one" and alone.next_sketch == alone.own_sketch


def test_query(spark):
    from gaugeflow.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    for k, (i, text) in enumerate(docs):
        half, following = len(text) // 2, docs[(k + 1) % len(docs)][1]
        new = text[:len(text) - half] + following[:half]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for value, other in ((r.near_edited, new), (r.near_next, following)):
            x, y = shingle_set(text), shingle_set(other)
            assert value == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0, abs=0.2)
