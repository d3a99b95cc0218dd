import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import coherence as C
from gaugeflow.operators import drift as D
from gaugeflow.operators import metrics as M
from gaugeflow.operators.quantiles import exact_quantiles


def _pool(values):
    blocks = []
    for v in values:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n]
    return [s / n for s, n in blocks for _ in range(n)]


def test_projection_equals_pooling(spark):
    rng = random.Random(7)
    hs = (5, 10, 30, 60, 120)
    rows = [tuple(round(rng.random(), rng.choice((1, 3))) for _ in hs) for _ in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"p_{h}m double" for h in hs))
    for r in C.coherent(df, hs).collect():
        raw, got = [r[f"unadjusted_p_{h}m"] for h in hs], [r[f"p_{h}m"] for h in hs]
        np.testing.assert_allclose(got, _pool(raw), atol=1e-12)
        assert abs(sum(raw) - sum(got)) < 1e-9
        if raw == sorted(raw):
            assert raw == got


def test_projection_refuses_bad_probabilities_and_unnested_labels(spark):
    with pytest.raises(Exception, match="finite and in"):
        C.coherent(spark.createDataFrame([(0.2, 1.2)], "p_5m double, p_10m double"), (5, 10)).collect()
    with pytest.raises(Exception, match="nested"):
        C.check_nested(spark.createDataFrame([(1, 0)], "observed_5m int, observed_10m int"), (5, 10)).collect()


# Published sweep rows: counts with their rounded precision, recall and F1.
GOLDEN = [
    (1102, 90, 211, 13956, 0.9245, 0.8393, 0.8798),
    (1133, 112, 365, 13651, 0.9100, 0.7563, 0.8261),
    (1230, 264, 784, 12598, 0.8233, 0.6107, 0.7013),
]


def test_rates_of_published_confusion_counts(spark):
    df = spark.createDataFrame([g[:4] for g in GOLDEN], "tp long, fp long, fn long, tn long")
    got = df.withColumns(M.rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])).collect()
    for r, g in zip(got, GOLDEN):
        assert [round(r[c], 4) for c in ("precision", "recall", "f1")] == [pytest.approx(x, abs=6e-5) for x in g[4:]]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(101) / 100) for _ in range(500)] + [(1, 0.29), (0, 0.57), (1, 0.58)]
    return rows, spark.createDataFrame(rows, "observed int, probability double").cache()


def test_sweep_equals_direct_comparison(scored):
    rows, df = scored
    for r in M.sweep(df).collect():
        t = round(r.threshold * 100) / 100
        tp = sum(1 for y, p in rows if y and p >= t)
        fp = sum(1 for y, p in rows if not y and p >= t)
        assert (r.tp, r.fp, r.tp + r.fn + r.fp + r.tn) == (tp, fp, len(rows))


def test_average_precision(spark, scored):
    rows, df = scored
    total, area = sum(y for y, _ in rows), 0.0
    for s in sorted({p for _, p in rows}):
        hit = [y for y, p in rows if p >= s]
        area += sum(y for y, p in rows if p == s) / total * sum(hit) / len(hit)
    got = M.average_precision(df.withColumn("g", F.lit(1)), ["g"]).first().average_precision
    assert abs(got - area) < 1e-12
    none = spark.createDataFrame([(1, 0, 0.3)], "g int, observed int, probability double")
    assert M.average_precision(none, ["g"]).first().average_precision is None


def test_blend_weight_keeps_the_model_unless_it_helps(spark):
    schema = "observed int, probability double, persistence double"
    good = spark.createDataFrame([(1, 0.9, 0.0), (0, 0.1, 1.0)], schema)
    assert M.blend_weight(good).first().weight == 1.0
    same = spark.createDataFrame([(1, 1.0, 1.0)], schema)
    assert M.blend_weight(same).first().weight == 1.0
    mixed = spark.createDataFrame([(1, 0.4, 1.0), (0, 0.4, 0.0)], schema)
    y, p, q = np.array([1, 0]), np.array([0.4, 0.4]), np.array([1.0, 0.0])
    want = float(np.clip(((y - q) * (p - q)).sum() / ((p - q) ** 2).sum(), 0, 1))
    assert M.blend_weight(mixed).first().weight == pytest.approx(want)


def test_quantiles_equal_linear_interpolation(spark):
    rng = random.Random(4)
    groups = {g: [rng.choice((rng.gauss(0, 5), 1.5, -2.0)) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 400))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    qs = (0.0, 0.1, 0.25, 0.5, 0.8, 1.0)
    for r in exact_quantiles(df, ["g"], "v", qs).collect():
        assert r.n == len(groups[r.g])
        np.testing.assert_allclose(r.q, np.quantile(groups[r.g], qs), atol=1e-9)
    assert exact_quantiles(df, [], "v", (0.5,)).count() == 1


def test_drift_of_constant_and_missing_features(spark):
    base_rows = spark.createDataFrame([(1.0, float(i)) for i in range(100)], "flat double, ramp double")
    base = D.baseline(base_rows, ["flat", "ramp"]).cache()
    flat = base.filter("feature = 'flat'").first()
    assert (flat.edges, flat.proportions, flat.std) == ([0.5, 1.5], [1.0], 0.0)
    recent = spark.createDataFrame([(float(i + 60),) for i in range(100)], "ramp double")
    got = {r.feature: r for r in D.compare(recent, base, ["flat", "ramp"]).collect()}
    assert got["flat"].status == "missing" and got["ramp"].status == "high"
    values = np.arange(100.0)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 11)))
    e = np.histogram(values, edges)[0] / 100
    a = np.clip(np.histogram(np.clip(np.arange(60.0, 160.0), edges[0], edges[-1]), edges)[0] / 100, 1e-6, None)
    assert got["ramp"].psi == pytest.approx(float(((a - e) * np.log(a / e)).sum()), rel=1e-4)
