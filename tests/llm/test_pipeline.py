from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gaugeflow.llm import toxicity
from gaugeflow.llm.common import store

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        docs, _ = store(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stage_names_and_columns(kept):
    assert [n for n, _ in pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    assert all(d.columns == kept[0].columns for d in kept[:-1]) and pipeline.ORACLE_SQL is None


def test_filters_keep_rows_as_they_were(kept):
    for before, after in zip(kept[:3], kept[1:4]):
        assert after.exceptAll(before).count() == 0


def test_language_keeps_clean_documents(kept):
    assert kept[1].count() == kept[0].where(F.col("text").rlike(r"\p{L}")).count()


def test_toxicity_rejects_the_toxic(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rate = {y: kept[2].join(labels.where(F.col("toxic") == y), "doc_id").count() / kept[1].join(labels.where(F.col("toxic") == y), "doc_id").count() for y in (0, 1)}
    assert rate[1] < 0.3 and rate[0] > 0.93


def test_toxicity_stage_follows_the_verdict(spark, monkeypatch):
    """A score from the operator's own cut up to 0.5 is toxic here too."""
    cut = toxicity.ToxicRule().cut
    score = F.col("text").cast("double")
    monkeypatch.setattr(toxicity, "train", lambda *_: None)
    monkeypatch.setattr(toxicity, "assess", lambda docs, _: docs.select(F.struct("*").alias("row"), score.alias("score"), (score >= cut).cast("int").alias("predicted")))
    docs = spark.createDataFrame([(k, str(s)) for k, s in enumerate((0.0, 0.29, 0.3, 0.4, 0.49, 0.5, 1.0))], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.drop_toxic(spark, docs, SF).collect()) == [0, 1]


def test_one_of_each_group_stays(kept):
    def shingles(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    before = sorted((r.doc_id, shingles(r.text)) for r in kept[2].collect())
    label = {d: d for d, _ in before}
    for k, (a, x) in enumerate(before):
        for b, y in before[:k]:
            both = len(x & y)
            if both and 100 * both >= 80 * (len(x) + len(y) - both) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if v == old else v for d, v in label.items()}
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(set(label.values()))
    assert len(set(label.values())) < len(before)


def test_mix_repeats_and_drops(kept):
    before, after = Counter(r.doc_id for r in kept[3].collect()), Counter(r.doc_id for r in kept[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 3 and after != before
    assert kept[4].distinct().exceptAll(kept[3]).count() == 0


def test_packing_covers_what_the_mix_took(kept):
    rows = kept[5].collect()
    assert sum(r.start == 0 for r in rows) == kept[4].count()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in used.values())


def test_run_is_the_stages_in_order(spark, kept):
    digest = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    whole = pipeline.run(spark, SF)
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in kept[5].collect())
    assert {d for d, *_ in digest(whole)} == {d for d, *_ in digest(kept[5])}


def test_stages_take_messy_and_empty_tables(spark, messy):
    docs = messy.withColumn("n_chars", F.char_length("text").cast("long"))
    for docs in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            docs, _ = store(stage(spark, docs, SF), "test-messy")
        rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert sum(r.start == 0 for r in rows) == docs.count()
