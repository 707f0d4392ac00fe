"""URL filters: pattern rules indexed by the rarest literal token of each of their spellings.

A rule is a regular expression over host and path, with the literal tokens of each spelling; every match holds all tokens
of a spelling.  Token counts over all URLs choose the rarest token of each spelling as an index key of the rule.  A URL
fetches the rules under its own tokens through an equi join, and only those rules' expressions run.  All steps are
DataFrame expressions; the rules enter the plan as one literal.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import ascii_lower, broadcast_within


@dataclass(frozen=True)
class Rule:
    """``pattern``: Java regular expression, searched in host + path.  ``spellings``: alphanumeric runs, lower case; any match contains those of one spelling as whole runs."""

    name: str
    verdict: str
    pattern: str
    spellings: tuple[tuple[str, ...], ...]
    weight: int


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains, where the URL's path starts with ``path``; longer rules weigh more.

    The path's last run of letters is open (it may go on in the URL), so it is no token unless something follows it.
    """
    closed = host + re.sub(r"[0-9A-Za-z]+$", "", path)
    pattern = r"^(?:[^/?#]*\.)?" + "".join("\\" + c if re.match(r"[^\w\s/]", c) else c for c in host + path)
    return Rule(host + path, verdict, pattern, (tuple(dict.fromkeys(re.findall(r"[0-9a-z]+", closed.lower()))),), 1_000_000 + len(host + path))


def pattern_rule(literal: str, verdict: str = "block") -> Rule:
    """Blocks host or path that holds the dash-joined words of ``literal`` as whole words, separated or fused."""
    words = literal.split("-")
    spellings = [words[:1]]
    for word in words[1:]:
        spellings = [spelling for s in spellings for spelling in ([*s, word], [*s[:-1], s[-1] + word])]
    return Rule(literal, verdict, r"(?i)(?:^|[^0-9a-z])" + "[-_.]?".join(words) + r"(?:$|[^0-9a-z])", tuple(map(tuple, spellings)), len(literal))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or end, A-Z lower-cased) and path (up to ? # or end); without :// both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_index(spark: SparkSession, rules: list[Rule], tokens: DataFrame) -> DataFrame:
    """(token, name, verdict, pattern, weight): each rule under the one token of each of its spellings that the fewest URLs hold."""
    listed = json.dumps([{"name": r.name, "verdict": r.verdict, "pattern": r.pattern, "spelling": n, "tokens": own, "weight": r.weight} for r in rules for n, own in enumerate(r.spellings)])
    schema = "array<struct<name string, verdict string, pattern string, spelling int, tokens array<string>, weight int>>"
    frame = spark.range(1).select(F.inline(F.from_json(F.lit(listed), schema)))
    wanted = frame.select("*", F.explode("tokens").alias("token")).drop("tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(broadcast_within(wanted.select("token").distinct(), 100_000), "token", "left_semi")
    rated = wanted.join(counts, "token", "left").groupBy("name", "verdict", "pattern", "weight", "spelling")
    return rated.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")).select("rarest.token", "name", "verdict", "pattern", "weight").distinct()


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """All columns of ``pages``, and host, path, rule and verdict; its own columns of those names get ``page_`` before them.

    The heaviest fitting rule gives rule and verdict (ties: the smaller name); without one, rule is null and the verdict
    is ``default``.  Null URLs, and such without ://, have empty host and path and fit no rule.  Repeated URLs are judged
    once, repeated rows stay; empty tables and an empty rule list are fine.  Rules are broadcast if they number at most
    ``broadcast_rules``; beyond it both joins shuffle.
    """
    taken = {*pages.columns, "host", "path", "rule", "verdict"}
    names = {c: next(n for k in range(1, 9) if (n := "page_" * k + c) not in taken) for c in pages.columns if c in ("host", "path", "rule", "verdict")}
    rows = pages.withColumn("__url", F.col(url_col)).withColumnsRenamed(names)
    host, path = url_parts(F.col("__url"))
    rows = rows.select("*", host.alias("host"), path.alias("path")).drop("__url")
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = rows.select("host", "path").distinct()
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat("host", "path")), F.lit("([0-9a-z]+)"), 1))
    tokens = urls.select("host", "path", F.explode(found).alias("token"))
    index = broadcast_within(rule_index(pages.sparkSession, rules, tokens), broadcast_rules)
    fits = tokens.join(index, "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("name", "verdict"), F.struct(-F.col("weight"), F.col("name"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        *[c for c in rows.columns if c not in ("host", "path")], "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


#: The site rules of the registered query, and words of unwanted sites.
SITE_RULES = [
    site_rule("org", "/", "allow"),
    site_rule("example.org", "/es/", "block"),
    site_rule("example.org", "/en/1", "block"),
    site_rule("com", "/fr/", "allow"),
    site_rule("com", "/de/", "block"),
]
PATTERN_RULES = [
    pattern_rule(w)
    for w in (
        "free-bets", "casino", "poker", "porn", "adult-chat", "malware", "phishing", "click-bait", "cheap-pills", "payday-loans",
        "online-slots", "sports-betting", "roulette", "blackjack-bonus", "sex-cam", "escort-service", "xxx", "nude-pics", "hentai", "hook-up-now",
        "keygen", "crack-download", "warez", "torrent-hub", "spyware", "ransomware", "botnet", "free-phone", "prize-winner", "lottery-win",
        "work-from-home", "get-rich-quick", "miracle-cure", "weight-loss-pill", "viagra", "fake-id", "replica-watches", "buy-followers", "link-farm", "essay-mill",
        "pirate-movies", "stolen-cards", "carding-forum", "dark-market", "hate-forum", "gore-video",
    )
]
