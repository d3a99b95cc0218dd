import math
import random
import re
import string

import pytest

from gaugeflow.llm.lexical import TERM, RankRule, classes, bags, search, tokens

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def by_hand(docs, items, k=50):
    """Every document row scored for every item."""
    bags_ = [(i, terms(t)) for i, t in docs]
    bags_ = [(i, b) for i, b in bags_ if b]
    n_docs, total = len(bags_), sum(len(b) for _, b in bags_)
    out = []
    for item, wanted in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags_) + 1))) for t in wanted}
        rows = []
        for doc_id, bag in bags_:
            m = 100 - 50 + (50 * len(bag) * n_docs) // total
            score = sum(w * ((10**9 * bag.count(t)) // (1000 * bag.count(t) + 20 * m)) for t, w in weight.items())
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if missing else doc_id, -score) for rank, (score, missing, doc_id) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


@pytest.mark.parametrize("rule", [RankRule(k=7), RankRule(k=7, pass_terms=12, part=3, cells=20), RankRule()])
def test_ranks_equal_every_document_scored(spark, rule):
    draw = random.Random(3)
    words = ["kalo", "MIREN", "tos", "uL", "vizan", "per9", "ñandú", "ÑANDÚ", "漢字", "x"]
    docs = [(n, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for n in range(120)]
    docs += [(n, docs[n % 5][1]) for n in range(200, 260)] + [(500, None), (501, ""), (502, "!! --"), (None, "kalo tos"), (None, "kalo tos"), (7, "kalo-kalo;tos"), (3, docs[3][1])]
    items = [(n, " ".join(draw.choices(words + ["nowhere"], k=6))) for n in range(9)] + [(9, None), (10, "??"), (0, "tos"), (None, "vizan ul"), (11, "tos x"), (11, "x Tos x")]
    assert found(search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), rule)) == by_hand(docs, items, rule.k)


def test_very_long_texts_messy_rows_and_clashing_names(spark, messy, prose):
    items = [(1, prose(1, 8)), (2, "one two"), (3, prose(99, 40))]
    extra = spark.createDataFrame([(*r, "d", "s") for r in items], "item_id long, text string, doc_id string, score string")
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert found(search(messy, extra)) == by_hand(docs, items)


def test_empty_tables(spark):
    none, one = frame(spark, [], "doc_id"), frame(spark, [(1, "kalo")], "doc_id")
    item = frame(spark, [(1, "kalo")], "item_id")
    for docs, items in ((none, item), (one, frame(spark, [], "item_id")), (frame(spark, [(1, None), (2, " ")], "doc_id"), item)):
        got = search(docs, items)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_parts_keep_terms_whole():
    text = "ab,,CD ñandú  漢字x".encode()
    for part in range(1, 12):
        assert [t for p in tokens(text, part) for t in p] == [b"ab", b"cd", "ñandú".encode(), "漢字x".encode()]


def test_a_hot_bag_is_one_class_with_its_first_members(spark):
    """A third of all documents have one bag, over many partitions."""
    docs = frame(spark, [(n, "kalo tos" if n % 3 == 0 else f"kalo w{n} filler" * (1 + n % 4)) for n in range(3000)], "doc_id").repartition(40)
    rule = RankRule()
    made = classes(bags(docs, [b"kalo", b"tos"], rule), 3000, 10_000, rule)
    # The group limit stands before the exchange, so no task receives the whole group.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")
    hot = [r for r in made.collect() if list(r.terms) == [0, 1]]
    assert [list(r.members) for r in hot] == [[3 * n for n in range(50)]]
