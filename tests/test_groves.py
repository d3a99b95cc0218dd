"""Forests fitted in groups: all trees, one mean, few partitions."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gaugeflow.operators import learning as M


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    made = [(float(a > 0.4) if draw.random() < 0.9 else 1.0, a, b, 1.0) for a, b in ((draw.random(), draw.random()) for _ in range(400))]
    table = spark.createDataFrame(made, "target double, a double, b double, weight double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table)


def test_groups_hold_all_trees_and_vote_as_one(rows):
    rule = M.ForestRule(trees=21, depth=6)
    grove = M._fitted(rule, rows.select("features", "target", "weight"))
    sizes = [f.getNumTrees for f in grove.forests]
    assert sum(sizes) == 21 and len(sizes) == rows.sparkSession.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 1
    assert len({f.getOrDefault("seed") for f in grove.forests}) == len(sizes)
    scored = M._voted(grove, rows.withColumn("id", F.monotonically_increasing_id()).cache())
    assert set(scored.columns) == {"target", "a", "b", "weight", "id", "raw_probability"}
    votes = [f.transform(rows).select(vector_to_array("probability")[1]).collect() for f in grove.forests]
    for got, *each in zip(scored.orderBy("id").collect(), *votes):
        assert got.raw_probability == pytest.approx(sum(v[0] * n for v, n in zip(each, sizes)) / 21)


def test_partitions_follow_the_rows(rows, monkeypatch):
    cores = rows.sparkSession.sparkContext.defaultParallelism
    ready, groups = M.dealt(rows.select("features", "target"), side_by_side=True)
    assert (ready.rdd.getNumPartitions(), groups) == (1, cores) and ready.count() == 400
    monkeypatch.setattr(M, "PART_ROWS", 130)
    assert M.dealt(rows.select("features", "target"), side_by_side=True)[1] == cores // 4
    assert M.dealt(rows.select("features", "target"), side_by_side=False)[1] == 1


def test_forests_remember_the_nodes_of_their_rows():
    forest = M._classifier(M.ForestRule())
    assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() == M.NODE_MB


def test_a_grove_walks_its_trees_as_spark_does(rows):
    from pyspark.ml.regression import RandomForestRegressor

    # Rows on both sides of every threshold, and on thresholds themselves; no Spark model is called in the plan.
    for forest, own in ((M._classifier(M.ForestRule(trees=9, depth=7)), lambda f: vector_to_array("probability")[1]),
                        (RandomForestRegressor(labelCol="target", numTrees=9, maxDepth=7, seed=3), lambda f: F.col("prediction"))):
        grove = M._grown(forest, rows.select("features", "target", "weight"), "vote")
        got = grove.transform(rows.select("a", "b", "features"))
        assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
        expected = [[v[0] for v in f.transform(rows).select(own(f)).collect()] for f in grove.forests]
        sizes = [f.getNumTrees for f in grove.forests]
        for i, r in enumerate(got.collect()):
            assert r.vote == pytest.approx(sum(e[i] * n for e, n in zip(expected, sizes)) / sum(sizes))
    trees = [(M.np.array([0, -1, -1]), M.np.array([0.5, 0, 0]), M.np.array([1, -1, -1]), M.np.array([2, -1, -1]), M.np.array([0, 1.0, 3.0]))]
    assert list(M.mean_of_trees(trees * 2, [M.np.array([v]) for v in (0.5, 0.6, 0.1)], most=2)) == [1.0, 3.0, 1.0]


def test_errors_walk_the_trees_once(rows):
    table = rows.select("a", "b", F.col("a").alias("temp"), F.col("b").alias("ahead"))
    model = M.fit_temperature(table, ["a", "b"], "ahead", trees=2, depth=2)
    errors = M.temperature_errors(model, table.withColumn("a", F.when(F.col("a") > 0.2, F.col("a"))), "ahead")
    assert errors._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert errors.first().n == table.filter("a > 0.2").count()
