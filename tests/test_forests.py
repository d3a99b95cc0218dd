"""Forests grown from arrays: the trees of Spark ML, in a fixed number of passes."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gaugeflow.operators import forests, learning as M


@pytest.fixture(scope="module")
def rows(spark):
    draw, made = random.Random(8), []
    for _ in range(700):
        a, b, c = draw.random(), draw.gauss(0, 3), float(draw.randrange(5))
        wet = float((a > 0.6) != (draw.random() < 0.2 + 0.1 * (c > 3)))
        made.append((wet, 20 + 5 * a + b * (c - 2) + draw.random(), a, b, c, 2.5 if wet else 0.75, 0.5 + draw.random()))
    table = spark.createDataFrame(made, "wet double, temp double, a double, b double, c double, even double, uneven double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table).coalesce(1).cache()


def _estimators(trees, depth, **more):
    wet = dict(featuresCol="features", labelCol="wet", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=4, **more)
    return {
        "even": RandomForestClassifier(weightCol="even", **wet), "uneven": RandomForestClassifier(weightCol="uneven", **wet),
        "value": RandomForestRegressor(**wet | {"labelCol": "temp"})}


@pytest.mark.parametrize("name", ["even", "uneven", "value"])
def test_a_tree_is_the_one_that_spark_grows(rows, name):
    estimator = _estimators(1, 6, bootstrap=False)[name]
    own = vector_to_array("probability")[1] if name != "value" else F.col("prediction")
    theirs = estimator.fit(rows)
    grove = M._grown(estimator, rows, "vote")
    assert grove.forests[0].totalNumNodes == theirs.totalNumNodes > 20
    expected = [r[0] for r in theirs.transform(rows).select(own).collect()]
    assert [r.vote for r in grove.transform(rows).collect()] == pytest.approx(expected)
    assert grove.forests[0].featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())


def test_depth_costs_no_passes(spark, rows):
    def jobs(depth):
        group = f"depth {depth}"
        spark.sparkContext.setJobGroup(group, group)
        M._grown(_estimators(8, depth)["even"], rows, "vote")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(9)


def test_more_rows_than_a_task_holds_stay_in_partitions(rows, monkeypatch):
    monkeypatch.setattr(M, "TASK_BYTES", 8 * 700 - 1)
    grove = M._grown(_estimators(8, 3)["value"], rows, "vote")
    assert sum(f.getNumTrees for f in grove.forests) == 8
    assert grove.transform(rows).select(F.corr("vote", "temp")).first()[0] > 0.5


def _held(kind, n=500):
    draw = np.random.default_rng(2)
    cells = draw.integers(0, 32, (n, 6), dtype=np.uint8)
    label = (cells[:, 0] + draw.integers(0, 20, n) > 25).astype(float) if kind != "value" else cells[:, 1] + draw.random(n)
    weight = draw.random(n) + 0.5 if kind == "uneven" else np.ones(n)
    words = [int(sum(int(b) << 5 * i for i, b in enumerate(row))).to_bytes(8, "little") for row in cells]
    batch = forests.pa.RecordBatch.from_pydict({"bins": words, "label": label, "weight": weight}, forests.pa.schema(
        [("bins", forests.pa.binary()), ("label", forests.pa.float64()), ("weight", forests.pa.float64())]))
    points = [np.arange(31.0)] * 3 + [np.array([])] + [np.arange(31.0)] * 3
    return forests.Rows(iter([batch.slice(0, 123), batch.slice(123)]), n, points, 32, kind != "value")


@pytest.mark.parametrize("kind", ["even", "uneven", "value"])
def test_the_size_of_a_step_changes_nothing(kind, monkeypatch):
    held, rule = _held(kind), forests.Growth(kind != "value", 7, 2, 0.0, 3, 32, 1, True)
    whole = forests.grow(held, rule, 0)
    monkeypatch.setattr(forests, "STEP_ROWS", 30)
    monkeypatch.setattr(forests, "NODE_CELLS", 400)
    steps = forests.grow(held, rule, 0)
    assert len(whole["gain"]) > 30
    for k, v in whole.items():
        assert np.allclose(v, steps[k]), k
    # Every draw lies in one leaf, and a parent's sums are those of its children.
    inner = np.flatnonzero(whole["left"] >= 0)
    left = whole["left"][inner]
    assert np.allclose(whole["sums"][:, inner], whole["sums"][:, left] + whole["sums"][:, left + 1])
    assert min(whole["count"]) >= 2 and len(forests.grow(held, rule, 1)["gain"]) != len(whole["gain"])


def test_features_of_a_node_differ():
    tried = forests.drawn_features(np.random.default_rng(0), 4000, 9, 4)
    assert all(len(set(t)) == 4 for t in tried.tolist())
    assert np.bincount(tried.ravel(), minlength=9) == pytest.approx(4000 * 4 / 9, rel=0.06)


def test_features_are_made_once_for_the_errors(spark, monkeypatch):
    from gaugeflow.plans import learning as L

    class Seen(Exception):
        pass

    def given(df, horizon):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(L, "split", given)
    with pytest.raises(Seen) as seen:
        L.temp_errors(spark, "/root/testdata/sf0.001")
    assert "Relation" in str(seen.value) and "Arrow" not in str(seen.value) and "Window" not in str(seen.value)
