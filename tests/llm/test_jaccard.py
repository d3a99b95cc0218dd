import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeflow.llm import jaccard
from gaugeflow.llm.jaccard import JaccardRule, Shingler, bitmap, folded, group_keys, join_documents, keep_heads, spanning_links


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_by_pairs(docs, rule):
    sets = [shingle_set(t, rule.words) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(docs, label):
        least[x] = min(d, least.get(x, d))
    return {d: (len(s), least[x]) for (d, _), s, x in zip(docs, sets, label)}


def edited(text, draw, n):
    words = text.split()
    for _ in range(n):
        k = draw.randrange(len(words))
        words[k:k + 1] = draw.choice([["new%d" % draw.randrange(9999)], [], [words[k], words[k]]])
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(prose):
    """Chains of edits around the threshold, shared passages, small and long texts."""
    draw, docs = random.Random(3), []
    passage = prose("p", 60)
    for base in range(14):
        text = prose(base, draw.choice([5, 8, 12, 30, 80, 200, 700]))
        for _ in range(9):
            docs.append(text)
            text = edited(text, draw, draw.randint(0, max(1, len(text.split()) // 40)))
    docs += [prose(f"q{k}", 30 + 5 * k) + " " + passage + " " + prose(f"r{k}", 20) for k in range(25)]
    docs += [passage, passage.upper(), "", "a", "a b", "a  b", "A B c"] + [docs[0]] * 3
    order = list(range(len(docs)))
    draw.shuffle(order)
    return [(k, docs[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("rule", [JaccardRule(4, 85, 100), JaccardRule(5, 80, 100), JaccardRule(2, 60, 100), JaccardRule(3, 95, 100)])
def test_components_equal_all_pairs(spark, corpus, rule):
    want = components_by_pairs(corpus, rule)
    assert len({c for _, c in want.values()}) < len(corpus) - 20
    got = join_documents(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4), rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {r.doc_id for r in got if r.is_head} == {c for _, c in want.values()}


def test_blocks_of_large_groups_lose_no_link(spark, corpus, monkeypatch):
    rule = JaccardRule(4, 85, 100, block=3)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    got = join_documents(spark.createDataFrame(corpus, "doc_id long, text string"), rule).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_pairs(corpus, rule)


def test_linked_sets_share_a_key(prose):
    """Any two sets within the threshold have a part in common, down to the worst case."""
    draw = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for rule in (JaccardRule(num=85), JaccardRule(num=80), JaccardRule(num=50)):
            for _ in range(150):
                n = int(draw.integers(1, 400))
                a = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64))
                union = len(a) * rule.den // rule.num
                extra = int(draw.integers(0, max(1, union - len(a) + 1)))
                both = -(-rule.num * (len(a) + extra) // rule.den)
                b = np.unique(np.concatenate([draw.permutation(a)[:both], draw.integers(0, 1 << 64, extra, dtype=np.uint64)]))
                got = len(np.intersect1d(a, b))
                if rule.den * got >= rule.num * (len(a) + len(b) - got) and len(a) != got:
                    assert set(group_keys(a, rule)) & set(group_keys(b, rule)), (len(a), len(b), got)


def test_tree_keeps_every_link(prose):
    draw, rule = random.Random(2), JaccardRule(num=85)
    with np.errstate(over="ignore"):
        shingler, sets = Shingler(rule), []
        for base in range(12):
            text = prose(base, 120)
            for _ in range(20):
                sets.append(shingler(text.encode()))
                text = edited(text, draw, 1)
    sizes, maps = np.array([len(s) for s in sets]), [bitmap(s) for s in sets]
    verify = lambda p, q: jaccard.linked(sets[p], sets[q], rule)
    for sides in (np.full(len(sets), 2), np.arange(len(sets)) % 2):
        label = list(range(len(sets)))
        for a, b in spanning_links(list(range(len(sets))), sizes, maps, sides, list(range(len(sets))), verify, rule):
            assert verify(a, b) and (sides[a] == 2 or sides[a] != sides[b])
            x, y = label[a], label[b]
            label = [y if v == x else v for v in label]
        for i in range(len(sets)):
            for j in range(i):
                if verify(i, j) and (sides[i] == 2 or sides[i] != sides[j]):
                    assert label[i] == label[j]


def test_stars():
    draw = random.Random(6)
    for _ in range(30):
        links = [(draw.randrange(30), draw.randrange(30)) for _ in range(draw.randrange(25))]
        label = {x: x for e in links for x in e}
        for _ in links:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        assert sorted(jaccard.as_stars(links)) == sorted((x, m) for x, m in label.items() if x != m)


def test_folding_keeps_bits():
    a, b = bitmap(np.arange(100, dtype=np.uint64)), bitmap(np.arange(10, dtype=np.uint64))
    assert folded([a, b]).shape == (2, len(b))


def test_messy_rows(spark, messy):
    got = defaultdict(list)
    for r in join_documents(messy).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.is_head))
    assert got[1] == [(36, 1, True)] and got[2] == [(36, 1, False)]
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)]
    assert got[7] == [(1, 7, True)] and got[12] == [(1, 7, False)]
    assert got[10][0][1:] == (9, False) and got[None][0][1] is None
    kept = keep_heads(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 11, None, 13] + ([3] if got[3][0][2] else []))
    assert join_documents(messy.limit(0)).count() == 0 and keep_heads(messy.limit(0)).count() == 0
