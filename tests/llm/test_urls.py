import re

import pytest

from gaugeflow.llm.queries import OP7_RULES
from gaugeflow.llm.urls import DEFAULT_RULES, UrlRule, address_rule, judge, judge_by_table, rule_table, token_counts, word_rule

URLS = [
    "http://example.com/en/x", "https://www.example.com/en/", "http://a.example.com/en/q?x=1", "http://example.com/enx", "http://badexample.com/en/", "http://shop.net/es/1", "http://net/fr/", "http://x.net/de/",
    "http://X.NET/es/#a", "ftp://h.org?x=/a", "http://h.com", "http://h.com/", "no scheme", "://", "http://casino-win.example.org/", "http://free.bets.org/a", "", None, "a://b://c/d", "http://h.net/ES/", "HTTP://EN.EXAMPLE.COM/en/",
    "http://www.example.com/EN/", "http://h.org/casinowin", "x\nhttp://n.com/a\nb",
]


def plain(url, rules):
    """Every rule tried on every url."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    lower = lambda s: re.sub("[A-Z]", lambda c: c[0].lower(), s)
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    hits = [r for r in rules if re.search(r.pattern, host + path if r.address else lower(url or ""))]
    best = max((r for r in hits if r.address), key=lambda r: len(r.text), default=None)
    spam = [r for r in hits if not r.address and r.action == "block"]
    return host, path, best and best.text, best.action if best else "block" if spam else "allow"


@pytest.fixture(scope="module")
def rules():
    return [address_rule(*r) for r in OP7_RULES] + list(DEFAULT_RULES)


def test_same_as_every_rule_on_every_url(spark, rules):
    more = [*rules, UrlRule("any", "block", "x=1$", ()), address_rule("h.com", "block"), word_rule("bets", "block")]
    urls = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    for given in (rules, more):
        got = judge(urls, given)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "pattern_rule", "verdict"]
        for r in got.collect():
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, given), r.url


def test_rules_are_filed_under_rare_tokens(spark):
    urls = spark.createDataFrame([("http://a.com/rare",), ("http://b.com/x",), ("http://com.com/y",), (None,)], "url string")
    assert token_counts(urls, ["com", "rare", "none"]) == {"com": 3, "rare": 1}


def test_edges(spark, rules):
    empty = spark.createDataFrame([], "url string")
    assert judge(empty, rules).count() == 0
    one = spark.createDataFrame([("http://a.com/",)], "url string")
    assert judge(one, []).first().verdict == "allow"
    with pytest.raises(ValueError):
        judge(one, [word_rule("a", "block")] * 10_001)


def test_a_last_token_that_may_go_on_is_no_literal():
    assert address_rule("example.com/en", "block").literals == ("example", "com")


def test_rules_from_a_table_judge_alike(spark, rules):
    more = [*rules, UrlRule("any", "block", "x=1$", ()), address_rule("h.com", "block"), word_rule("bets", "block"), address_rule("com/", "block")]
    urls = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    for given in (rules, more, []):
        got, want = judge_by_table(urls, rule_table(spark, given)), judge(urls, given)
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert judge_by_table(urls.limit(0), rule_table(spark, rules)).count() == 0


def test_ten_thousand_rules_meet_few_urls(spark):
    """Far more rules than one task's argument may hold; each url meets those of its rare tokens only."""
    many = [address_rule(f"site{k}.org/a/", "block") for k in range(12_000)] + [word_rule(f"word{k} word{k + 1}", "block") for k in range(500)]
    urls = spark.createDataFrame([(f"http://x.site{k}.org/a/{'b' * (k % 50)}",) for k in range(0, 24_000, 7)] + [("http://y.net/word3-word4?z",), ("http://y.net/word3/word5",)], "url string")
    got = {r.url: (r.rule, r.pattern_rule, r.verdict) for r in judge_by_table(urls, rule_table(spark, many)).collect()}
    assert got["http://y.net/word3-word4?z"] == (None, "word3 word4", "block") and got["http://y.net/word3/word5"] == (None, None, "allow")
    for k in range(0, 24_000, 7):
        assert got[f"http://x.site{k}.org/a/{'b' * (k % 50)}"][0] == (f"site{k}.org/a/" if k < 12_000 else None)


def test_very_long_urls(spark, rules):
    long = "http://h.org/" + "a/" * 100_000 + "free-bets"
    urls = spark.createDataFrame([(long,), (long + "x",)], "url string")
    for made in (judge(urls, rules), judge_by_table(urls, rule_table(spark, rules))):
        assert {(len(r.path), r.verdict) for r in made.collect()} == {(len(long) - 12, "block"), (len(long) - 11, "allow")}
