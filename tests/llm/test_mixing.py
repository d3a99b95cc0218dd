import random
import re
from collections import Counter, defaultdict

import pytest

from gaugeflow.llm.mixing import MixRule, apply_mix, mix, source_targets


def targets_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Shares handed out anew until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left, w = total - sum(capped.values()), sum(weight[s] for s in order if s not in capped)
        share = {s: left * weight[s] / w for s in order if s not in capped} if w else {}
        over = {s: most * sizes[s] for s, v in share.items() if v > most * sizes[s] + 1e-9}
        if not over:
            return capped | share
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 7}, {"a": 0, "b": 5}, {"x": 10}, {"a": 3, "b": 4, "c": 5, "d": 4000, "e": 1, "f": 0}, {"é": 9, "z": 90, "Z": 900}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    want = targets_by_rounds(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_totals_come_near_and_reruns_agree(spark, prose):
    draw = random.Random(1)
    rows = [(k, prose(k, draw.randint(0, 60)), draw.choice(["hot"] * 6 + ["b", "c", None])) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, MixRule(fan=8)).collect()
    again = mix(docs.repartition(7), MixRule(fan=8)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t, _ in rows}
    taken, target, total = Counter(), {}, Counter()
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        total[r.source] += r.size
        target[r.source] = r.target
    want = targets_by_rounds(dict(total))
    assert len(got) == 3000
    for s in target:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= 60


def test_rounding_is_fair(spark):
    """Over many seeds a document is taken as often as its share says."""
    docs = spark.createDataFrame([(k, "w " * (1 + k % 4), "a" if k < 40 else "b") for k in range(60)], "doc_id long, text string, source string")
    seen, due = defaultdict(int), {}
    for seed in range(20):
        for r in mix(docs, MixRule(fan=4, seed=1000 * seed)).collect():
            seen[r.source] += r.copies
            due[r.source] = r.target / r.source_size
    for s, n in (("a", 40), ("b", 20)):
        assert seen[s] / 20 / n == pytest.approx(due[s], rel=0.1)


def test_messy_rows(spark, messy):
    got = mix(messy).collect()
    assert len(got) == messy.count()
    assert all(r.taken == 0 for r in got if r.doc_id in (4, 5, 6))
    kept = apply_mix(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for d, n in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if n})
    assert mix(messy.limit(0)).count() == 0 and apply_mix(messy.limit(0)).count() == 0


def test_a_large_document_is_outweighed_by_small_ones(spark):
    """Sources of about fifty documents, one of them ten times as long as most, come within a small document of their targets."""
    draw = random.Random(9)
    rows, sizes = [], {}
    for s in range(12):
        for k in range(50):
            n = 700 if k == 0 else draw.randint(1, 240)
            rows.append((1000 * s + k, "w " * n, f"s{s:02d}"))
            sizes[f"s{s:02d}"] = sizes.get(f"s{s:02d}", 0) + n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for rule in (MixRule(), MixRule(seed=5)):
        taken, target = Counter(), {}
        for r in mix(docs, rule).collect():
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert max(abs(taken[s] - target[s]) / target[s] for s in target) < 0.03


def test_every_document_keeps_its_expectation(spark):
    """Pooled small documents are moved together, but each is still taken as often as its share says."""
    docs = spark.createDataFrame([(k, "w " * (200 if k == 0 else 3 + k % 5), "a" if k < 30 else "b") for k in range(45)], "doc_id long, text string, source string")
    seen, due = Counter(), {}
    for seed in range(16):
        for r in mix(docs, MixRule(seed=77 * seed)).collect():
            seen[r.doc_id] += r.copies / 16
            due[r.doc_id] = r.target / r.source_size
    assert all(abs(seen[d] - due[d]) < 0.55 for d in due)
    for part in (range(1, 30), range(30, 45)):
        assert sum(seen[d] - due[d] for d in part) == pytest.approx(0, abs=2)
