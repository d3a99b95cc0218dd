import random

import numpy as np
import pytest

from gaugeflow.llm.negatives import Lists, MineRule, best, mine, near_positives, pack, pad

COLUMNS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, rule=MineRule()):
    """All scores of every anchor, row by row."""
    good = [(v, l, np.floor(rule.scale * np.array(e, dtype=np.float32).astype(float)).astype(np.int64)) for v, e, l in rows if l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, (anchor, label, x) in enumerate(good):
        if anchor is None or anchor % rule.every:
            continue
        scores = [(int(x @ y), v, l) for b, (v, l, y) in enumerate(good) if b != a and len(y) == len(x)]
        for p, positive, _ in sorted((s for s in scores if s[2] == label), key=order)[: rule.positives]:
            window = sorted((s for s in scores if s[2] != label and rule.num * p <= rule.den * s[0] <= rule.den * p), key=order)
            out += [(anchor, positive, rank, v, p, n) for rank, (n, v, _) in enumerate(window[: rule.negatives], 1)]
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((6, 12))
    rows = []
    for n in range(900):
        v = centres[n % 6] + draw.standard_normal(12) * 0.8
        rows.append((n, [float(np.float32(c)) for c in v / np.linalg.norm(v)], int(n % 6 if draw.random() < 0.7 else draw.integers(-3, 90))))
    copy = rows[100][1]
    rows += [(n, copy, n % 4) for n in range(1000, 1300)]  # a crowd of equal vectors, and ties
    return rows


@pytest.mark.parametrize("rule", [MineRule(), MineRule(cells=12 * 64, kinds=4, first=2), MineRule(cells=24, first=1)])
def test_negatives_equal_all_scores(spark, vectors, rule):
    rows = vectors if rule.cells > 100 else vectors[:130]
    want = by_hand(rows, rule)
    assert want and found(mine(spark.createDataFrame(rows, COLUMNS).repartition(7), rule)) == want


def test_defined_cases(spark):
    """Rows that take no part, other lengths, null and repeated ids, repeated rows, large numbers, labels below zero."""
    nan, inf, draw = float("nan"), float("inf"), random.Random(1)
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [0.9, 0.1], 2), (None, [1.0, 0.1], 1), (None, [0.95, 0.0], 3), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1),
        (6, [1.0, 0.0], None), (7, [1.0, 0.0, 0.0], 1), (100, [0.5, 0.5, 0.1], 1), (8, [0.5, 0.4, 0.1], -2), (200, [], 1), (9, [], 1), (10, [], 2), (300, [0.0, 0.0], 5), (11, [-1.0, -1.0], 5), (12, [0.0, 1.0], 2),
        (400, [900.0, -900.0], 7), (13, [800.0, -800.0], 7), (14, [700.0, -799.0], 1), (-100, [-0.3, 0.2], -2), (15, [-0.3, 0.25], -2), (16, [-0.3, 0.22], 4),
    ] + [(20 + k, [draw.uniform(-1, 1), draw.uniform(-1, 1)], draw.randrange(3)) for k in range(40)]
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], COLUMNS + ", block string, score int")
    assert found(mine(frame)) == by_hand(rows)
    far = spark.createDataFrame([(0, [3e38, -3e38], 1), (1, [3e38, 1.0], 1), (2, [1e30, -3e38], 2)], COLUMNS)
    edge = MineRule().limit
    assert found(mine(far)) == [(0, 1, 1, 2, edge * edge - 256 * edge, 2 * edge * edge)] * 0  # the only other label scores above the positive


def test_empty_tables_and_single_labels(spark):
    assert mine(spark.createDataFrame([], COLUMNS)).count() == 0
    assert mine(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], COLUMNS)).count() == 0


def test_sorted_access_stops_early(spark):
    """Where one direction stands out the lists are not read to their ends."""
    draw = np.random.default_rng(2)
    x = np.floor(draw.standard_normal((4000, 3)) * 20)
    x[:50, 0] += 4000
    orders = bytes([1]) * 4000 + np.argsort(x.T, axis=1, kind="stable").astype(np.int32).tobytes()
    lists = Lists(np.arange(4000).tobytes(), np.ones(4000, np.int64).tobytes(), pack(x), orders, 3, MineRule())
    anchor, seen = np.array([[5, 0, -1]]), []
    search = lists.search
    lists.search = lambda a, y, done: seen.append(search(a, y, done)) or seen[-1]
    (_, got), = near_positives(lists, anchor, [1], [-1], MineRule())
    scores = (x @ anchor[0]).astype(np.int64)
    order = np.lexsort((np.arange(4000), -scores))[:5]
    assert got.tolist() == [[int(i), int(scores[i])] for i in order]
    assert len(seen[0][0]) < 1000
    assert pad(5) == 8 and best(np.arange(3), np.array([1, 1, 1]), lists, 5)[:, 0].tolist() == [0, 1, 2]


def test_hot_label_is_dealt_to_many_blocks(spark, vectors):
    rule = MineRule(cells=12 * 50)
    rows = [(v, e, 1 if v % 3 == 0 else l) for v, e, l in vectors]
    assert found(mine(spark.createDataFrame(rows, COLUMNS), rule)) == by_hand(rows, rule)


def test_query_moves_labels(spark):
    from gaugeflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    moved = [(v, e, (l + 1) % 10 if v % 7 == 0 else l) for v, e, l in rows]
    assert found(QUERIES["op13_negatives"](spark, sf)) == by_hand(moved)
