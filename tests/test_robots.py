"""Robots files against the standard library's parser."""

import random
from urllib.robotparser import RobotFileParser

from weftline.operators.robots import Trie, canonical_target, groups, parse_robots, robots_filter

LINES = [
    "User-agent: *", "User-agent: bot", "user-agent : Bot/2", "User-agent: other # x", "User-agent:", "Disallow: /", "Disallow:", "Disallow: /a", "Allow: /a/b", "Disallow: /a;p=1",
    "Disallow: /%7Ejoe", "Disallow: /~joe/x", "Allow: *", "Disallow: /*.pdf", "Disallow: /caf\u00e9", "Allow: /caf%C3%A9/x", "Disallow: /a?b", "Disallow: /q?", "Crawl-delay: 3", "Crawl-delay: x",
    "Request-rate: 1/5", "Sitemap: https://e.com/s.xml", "nothing", "", "", " ", "# note", "  Allow:/z  ", "Disallow: //h/x", "Disallow: /a%2fb", "Disallow: a"]
URLS = ["", "/", "/a", "/a/b", "/a/b/c", "/a;p=1", "/a;p=2", "/~joe", "/%7Ejoe/x", "/%7ejoe", "/x.pdf", "/*.pdf", "/caf\u00e9/x", "/caf%c3%a9/y", "/a?b=1", "/a?c", "/q", "/q?x#f", "/z", "//h/x", "/a%2Fb", "/b#a"]
AGENTS = ["*", "bot", "Bot/1.0", "other", "mybot 2", "no"]


def files():
    rng = random.Random(3)
    return [rng.choice(["\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randrange(14))) for _ in range(400)]


def plain(text):
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def test_generated_files_equal_the_standard_library(spark):
    texts = {f"h{k}.example": t for k, t in enumerate(files())}
    rules = parse_robots(spark.createDataFrame([*texts.items(), ("none.example", None)], "host string, text string"))
    urls = [f"https://{h}{u}" for h in [*texts, "none.example", "unknown.example"] for u in URLS]
    df = spark.createDataFrame([(u,) for u in urls] + [(None,), ("x",), ("",)], "url string")
    parsers = {h: plain(t) for h, t in texts.items()}
    for agent in AGENTS:
        got = {r.url: r.robots_ok for r in robots_filter(df, rules, agent).collect()}
        wrong = [(u, got[u]) for u in urls if got[u] != (parsers[u.split("/")[2]].can_fetch(agent, u) if u.split("/")[2] in parsers else True)]
        assert not wrong, (agent, wrong[:5])
        assert got[None] and got["x"] and got[""]


def test_groups():
    assert groups("User-agent: a\nUser-agent: b\nDisallow: /x\nUser-agent: c\n\nAllow: /") == [(["a", "b"], [(False, "/x")])]
    assert groups("User-agent: a\nCrawl-delay: 1\nUser-agent: b\nAllow: /") == [(["a"], []), (["b"], [(True, "/")])]


def test_trie_takes_the_first_rule_and_one_walk():
    rules = [(k, k % 2 == 0, "/" + "ab"[k % 2] * (k % 7) + str(k)) for k in range(3_000)] + [(3_000, False, "/a"), (3_001, True, "/aa")]
    trie = Trie(rules)
    for target in ("/aa2", "/a", "/aab", "/b1", "/", "/aa9x", "/bb3", "/0"):
        first = min((r for r in rules if target.startswith(r[2])), default=None)
        assert trie.allows(target) == (first is None or first[1])


def test_targets():
    assert [canonical_target(u) for u in ("https://e.com", "https://e.com/%7ea?b=%20", "https://e.com/a;p?q#f")] == ["/", "/~a%3Fb%3D%20", "/a%3Bp%3Fq%23f"]


def test_columns_with_other_names_stay(spark):
    rules = parse_robots(spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /a")], "host string, text string"))
    df = spark.createDataFrame([("https://e.com/a", "k", 1)], "at string, host string, rules int").withColumnRenamed("rules", "a.b")
    out = robots_filter(df, rules, url="at")
    assert out.columns == ["at", "host", "a.b", "robots_ok"] and tuple(out.first()) == ("https://e.com/a", "k", 1, False)
