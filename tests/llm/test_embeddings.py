import math

import numpy as np
import pytest

from gaugeflow.llm.components import components
from gaugeflow.llm.embeddings import StableRule, near_duplicates, shape

COLUMNS = "vec_id long, embedding array<float>, label int, node string, links string"


def by_pairs(rows, cosine=0.9):
    good = [(v, np.array(e, dtype=float)) for v, e in rows]
    unit = np.array([e / np.linalg.norm(e) for _, e in good])
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(rows))])
        if (new == label).all():
            break
        label = new
    ids = np.array([v for v, _ in rows])
    return {v: (int(near[k].sum()), int(ids[label == label[k]].min())) for k, (v, _) in enumerate(good)}


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(8)
    rows = [draw.standard_normal(32) for _ in range(300)]
    for k in range(0, 60, 3):
        for noise in (0.05, 0.15, 0.3, 0.45):
            rows.append(rows[k] + noise * draw.standard_normal(32))
    crowd = draw.standard_normal(32)
    rows += [crowd + 0.1 * draw.standard_normal(32) for _ in range(150)] + [crowd] * 40 + [3 * crowd] * 5
    return [(int(v), [float(np.float32(x)) for x in rows[k]]) for k, v in enumerate(draw.permutation(len(rows)))]


def test_links_and_components(spark, vectors):
    want = by_pairs(vectors)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()}
    assert got.keys() == want.keys()
    found, due = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert due > 20_000 and found >= 0.97 * due
    assert all(got[v].n_links <= n for v, (n, _) in want.items())
    assert sum(got[v].component_id == c for v, (_, c) in want.items()) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_count_the_same(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    one, many = (sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(frame, StableRule(block=b)).collect()) for b in (1024, 16))
    assert one == many


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]),
        (11, [-1.0, 0.0]), (12, [0.9, math.sqrt(1 - 0.8)]), (13, [1e-30, 0.0]), (14, [3e38, 0.0]),
    ]
    frame = spark.createDataFrame([(v, e, 1, "n", "l") for v, e in rows], COLUMNS)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(frame).collect())
    crowd = [1, 2, 10, 10, 13, 14]
    for v, n, c, kept in got:
        want = (5, 1, v == 1) if v in crowd else (0, v or None, True)
        if v == 12:
            continue
        assert (n, c, kept) == want, v
    assert near_duplicates(frame.limit(0)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).first().n_links == 0


def test_more_vectors_get_more_selective_tables():
    assert shape(1000, StableRule())[0] < shape(10**6, StableRule())[0] and shape(0, StableRule())[1] >= 1


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(k, 2 * k) for k in range(1, 50)], [(5, 9), (9, 5), (9, 7), (20, 21)], [(k, 100) for k in range(40)]])
def test_components(spark, edges):
    label = {v: v for e in edges for v in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: x for v, x in label.items() if any(a != b and v in (a, b) for a, b in edges)}
