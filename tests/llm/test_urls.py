import re
from collections import Counter

from chronolith.llm import urls

SITES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    None, "", "no scheme", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/1234?x=/es/", "https://example.org/en/2", "https://xexample.org/es/", "http://org/", "http://org",
    "ftp://m.Example.com/fr/x#y", "http://com/de/", "http://example.com/DE/", "http://example.com/de", "http://u@example.org:80/es/", "http://example.org:80/es/", "://host/p", "http://a://b/c", "http://free-bets.example.net/q",
    "http://x.net/play/casino/1", "http://casinos.net/", "http://example.org/es/casino", "http://é.org/ü?ü", "http://a.org/\nline", "http://" + "a" * 100_000 + ".org/es/", "http://example.org/es/1", "http://example.org/es/1",
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.split(r"[/?#]", rest, maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in cut)
        path = re.split(r"[?#]", rest[len(cut) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[1:])
    for rule in sorted(urls.PATTERN_RULES, key=lambda r: (-len(r.name), r.name)):
        if re.search(r"(?:^|[^0-9a-z])" + rule.name.replace("-", "[-_.]?") + r"(?:$|[^0-9a-z])", host + path, re.I):
            return host, path, rule.name, "block"
    return host, path, None, "allow"


def test_judgements_match_brute_force(spark):
    rows = [(n if n % 5 else None, u, "clash", n) for n, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, token int")
    for bound in (0, 1000):
        found = urls.judge(pages, urls.SITE_RULES + urls.PATTERN_RULES, broadcast_rules=bound)
        assert found.columns == ["page_id", "url", "page_verdict", "token", "host", "path", "rule", "verdict"]
        assert Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect()) == Counter((u, *brute(u)) for u in URLS)


def test_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge(pages, []).collect()[0].verdict == "allow"
    assert urls.judge(pages.limit(0), urls.SITE_RULES).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    tokens = spark.createDataFrame([("org",)] * 3 + [("example",)] * 5 + [("es",)], "token string")
    index = {r["name"]: r.token for r in urls.rule_index(spark, urls.SITE_RULES, tokens).collect()}
    assert index["example.org/es/"] == "es" and index["org/"] == "org" and index["example.org/en/1"] == "en"


def test_fused_words_are_found(spark):
    asked = ["http://freebets.example.net/", "http://a.net/ClickBait/x", "http://a.net/adultchat", "http://cheappills.net/", "http://a.net/x/paydayloans?q", "http://a.net/free.bets/", "http://a.net/freebetsx/", "http://freebets.free-bets.net/"]
    found = urls.judge(spark.createDataFrame([(u,) for u in asked], "url string"), urls.SITE_RULES + urls.PATTERN_RULES)
    assert Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in found.collect()) == Counter((u, *brute(u)) for u in asked)
    assert found.where("verdict = 'block'").count() == 7


def test_each_spelling_of_three_words_is_indexed():
    assert set(urls.pattern_rule("a-b-c").spellings) == {("a", "b", "c"), ("ab", "c"), ("a", "bc"), ("abc",)}


def test_all_spellings_of_all_rules_match_running_every_rule(spark):
    asked = []
    for rule in urls.PATTERN_RULES:
        words = rule.name.split("-")
        for between in ("-", "", "_", ".", "+"):
            asked += [f"http://{between.join(words)}.example.net/", f"http://a.net/x/{between.join(words).upper()}", f"http://a.net/q{between.join(words)}/", f"http://a.net/{between.join(words)}s"]
        asked += ["http://a.net/" + words[0] + "".join(("-", "")[n % 2] + w for n, w in enumerate(words[1:])), "http://a.net/" + words[0] + "".join(("", "_")[n % 2] + w for n, w in enumerate(words[1:]))]
    asked = list(dict.fromkeys(asked))
    found = urls.judge(spark.createDataFrame([(u,) for u in asked], "url string"), urls.SITE_RULES + urls.PATTERN_RULES)
    assert sorted((r.url, r.rule, r.verdict) for r in found.where("verdict = 'block'").collect()) == sorted((u, *brute(u)[2:]) for u in asked if brute(u)[3] == "block")
    assert found.count() == len(asked)
