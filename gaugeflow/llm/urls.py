"""URL verdicts by pattern rules that are found through their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, store

#: Rules are an argument held in every task; their number is bounded.
MOST_RULES = 10_000
NOT_TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` (Java regex) runs on host + path if ``address``, else on the lower-cased url.

    ``literals`` are whole tokens (runs of a-z and 0-9, lower case) of every url
    that the pattern can match; without any the rule is tried on every url.
    """

    text: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    address: bool = False


def _tokens(literal: str) -> list[str]:
    return [t for t in re.split(NOT_TOKEN, literal.lower()) if t]


def address_rule(text: str, action: str) -> UrlRule:
    """``host/path``: the host and its subdomains, paths that start so."""
    tokens = _tokens(text)
    if re.search("[a-zA-Z0-9]$", text):  # the url may go on with the last token
        tokens = tokens[:-1]
    quoted = re.sub(r"([^a-zA-Z0-9])", r"\\\1", text)
    return UrlRule(text, action, rf"^(?:[^/]*\.)?{quoted}", tuple(dict.fromkeys(tokens)), True)


def word_rule(words: str, action: str) -> UrlRule:
    """Consecutive whole tokens anywhere in the url, any separators between them."""
    tokens = _tokens(words)
    return UrlRule(words, action, f"(?:^|[^a-z0-9]){NOT_TOKEN.join(tokens)}(?:[^a-z0-9]|$)", tuple(dict.fromkeys(tokens)))


#: What decides where no address rule fits.
DEFAULT_RULES = tuple(word_rule(w, "block") for w in ("casino win", "free bets", "cheap pills", "adult", "xxx", "porn", "gambling", "payday loans", "wp login", "cgi bin"))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(F.coalesce(url, F.lit(""))), NOT_TOKEN))


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens occurs."""
    if not tokens:
        return {}
    found = urls.select(F.explode(F.array_intersect(url_tokens(F.col("url")), _texts(tokens))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """Adds ``host, path, rule, pattern_rule, verdict``; the rest of ``urls`` is kept.

    Each rule is filed under that of its literal tokens which the fewest urls
    have. A url's tokens fetch the rules filed under them, and only those run
    their regular expression. Of the address rules that match, the longest text
    wins (the earlier on a tie) and decides; where none does, a matching block
    pattern decides, else the url is allowed. Rows are judged where they are:
    nothing is shuffled but the token counts.

    A null url, or one without ``://``, has an empty host and path and only
    patterns can match it. Columns of ``urls`` with the names of added ones are
    replaced. An empty table gives no rows. Repeated urls are judged alike; a url
    is read whole, however long. More than ``MOST_RULES`` rules raise
    ``ValueError``: they are a table for ``judge_by_table``.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}, more are a table for judge_by_table")
    counts = token_counts(urls, sorted({t for r in rules for t in r.literals}))
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        if rule.literals:
            index.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(k)
    free = F.array(*[F.lit(k) for k, r in enumerate(rules) if not r.literals]).cast("array<int>")
    filed = F.map_from_arrays(_texts(index), F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in index.values()]).cast("array<array<int>>"))
    fetched = F.flatten(F.transform(F.array_intersect(F.col("u.tokens"), _texts(index)), lambda t: F.element_at(filed, t))) if index else F.array().cast("array<int>")
    facts = F.array(*[
        F.struct(F.lit(r.text).alias("text"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"), F.lit(r.address).alias("address"), F.lit(k).alias("at"))
        for k, r in enumerate(rules)
    ]) if rules else F.array().cast("array<struct<text:string,action:string,pattern:string,address:boolean,at:int>>")

    def runs(fact):
        subject = F.when(fact["address"], F.concat(F.col("u.host"), F.col("u.path"))).otherwise(F.col("u.lower"))
        return F.rlike(subject, fact["pattern"])

    url = F.col("row.url")
    seen = urls.select(F.struct("*").alias("row")).select("row", F.struct(
        host_of(url).alias("host"), path_of(url).alias("path"), lower_ascii(F.coalesce(url, F.lit(""))).alias("lower"), url_tokens(url).alias("tokens")
    ).alias("u"))
    tried = seen.select("row", "u.host", "u.path", F.filter(F.transform(F.concat(fetched, free), lambda k: facts[k]), runs).alias("hits"))
    longest = F.array_max(F.transform(F.filter("hits", lambda h: h["address"]), lambda h: F.struct(F.length(h["text"]).alias("n"), (-h["at"]).alias("at"), h["text"].alias("text"), h["action"].alias("action"))))
    pattern = F.array_min(F.transform(F.filter("hits", lambda h: ~h["address"] & (h["action"] == "block")), lambda h: F.struct(h["at"].alias("at"), h["text"].alias("text"))))
    decided = tried.select("row", "host", "path", longest.alias("best"), pattern.alias("spam"))
    added = ("host", "path", "rule", "pattern_rule", "verdict")
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("spam").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return decided.select(
        *[F.col("row")[c].alias(c) for c in urls.columns if c not in added], "host", "path", F.col("best.text").alias("rule"), F.col("spam.text").alias("pattern_rule"), verdict.alias("verdict")
    )


RULES = "at long, text string, action string, pattern string, literals array<string>, address boolean"


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """Rules as a table for ``judge_by_table``; ``at`` is their order."""
    return spark.createDataFrame([(k, r.text, r.action, r.pattern, list(r.literals), r.address) for k, r in enumerate(rules)], RULES)


def judge_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``judge``, for any number of rules in a table of the columns ``RULES``.

    Every rule is filed under that of its literals which the fewest urls have,
    by counts of the rules' literals alone; the tokens of the distinct urls meet
    the filed rules in a join, and only those run their expressions. Rules
    without a literal are tried on every url: at most ``MOST_RULES`` of them.
    """
    spark = urls.sparkSession
    rules, _ = store(rules.select(*[f.split()[0] for f in RULES.split(", ")]), "url-rules")
    lower = lower_ascii(F.coalesce(F.col("url"), F.lit("")))
    subject = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    distinct, _ = store(urls.select("url").distinct().select("url", lower.alias("lower"), subject.alias("subject"), F.explode(url_tokens(F.col("url"))).alias("token")), "url-tokens")
    literal = rules.select("at", F.explode("literals").alias("token"))
    seen = distinct.join(literal.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    filed = literal.join(seen, "token", "left").groupBy("at").agg(rarest).join(rules.drop("literals"), "at")
    free = rules.where(F.coalesce(F.size("literals"), F.lit(0)) <= 0).drop("literals").limit(MOST_RULES + 1).collect()
    if len(free) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules have no literal")
    met = distinct.join(filed, "token")
    if free:
        everywhere = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("at", "text", "action", "pattern", "address")]) for r in free])
        any_url = distinct.select("url", "lower", "subject").distinct().select("*", F.explode(everywhere).alias("r")).select("url", "lower", "subject", "r.*")
        met = met.select(*any_url.columns).unionByName(any_url)
    hits = met.where(F.rlike(F.when(F.col("address"), F.col("subject")).otherwise(F.col("lower")), F.col("pattern")))
    best = F.max(F.when(F.col("address"), F.struct(F.length("text").alias("n"), (-F.col("at")).alias("at"), "text", "action")))
    spam = F.min(F.when(~F.col("address") & (F.col("action") == "block"), F.struct("at", "text")))
    found = hits.groupBy(F.col("url").alias("judged")).agg(best.alias("best"), spam.alias("spam"))
    joined = urls.select(F.struct("*").alias("row")).join(found, F.col("row.url").eqNullSafe(F.col("judged")), "left")
    url, added = F.col("row.url"), ("host", "path", "rule", "pattern_rule", "verdict")
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("spam").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in urls.columns if c not in added], host_of(url).alias("host"), path_of(url).alias("path"),
        F.col("best.text").alias("rule"), F.col("spam.text").alias("pattern_rule"), verdict.alias("verdict"))
