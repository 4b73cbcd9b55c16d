from __future__ import annotations

import random
import re
from urllib.robotparser import RobotFileParser

import presscan as ps

AGENT = "Mozilla/5.0 (X11) Safari/537"


def judge(spark, web, files: dict[str, str], urls: list[str], agent: str = AGENT, floor: float = 1.0):
    docs = web(*[(f"{origin}/robots.txt", "robots", body) for origin, body in files.items()])
    rows = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    verdict = ps.robots_verdict(rows, ps.robots_policies(docs), agent, floor).orderBy("i")
    return [(r["allowed"], r["delay"]) for r in verdict.collect()]


def test_disallow_allow_and_delay(spark, web):
    body = "\nUser-agent: *\nDisallow: /buscar/\nDisallow: /?q=\nCrawl-delay: 3\nSitemap: https://a.test/s.xml\n"
    urls = ["/buscar/?x", "/?q=uno", "/2031/nota", "/s.xml", ""]
    got = judge(spark, web, {"https://a.test": body}, [f"https://a.test{u}" for u in urls])
    assert got == [(False, 3.0), (False, 3.0), (True, 3.0), (True, 3.0), (True, 3.0)]
    assert judge(spark, web, {"https://a.test": body}, ["https://a.test/x"], floor=5.0) == [(True, 5.0)]


def test_missing_and_failed_files_allow_everything(spark, web):
    docs = web(("https://b.test/robots.txt", "robots", "User-agent: *\nDisallow: /", 1, 503), ("https://c.test/robots.txt", "robots", ""),
               ("https://a.test/sub/robots.txt", "robots", "User-agent: *\nDisallow: /"))
    urls = spark.createDataFrame([(f"https://{h}.test/x",) for h in "abc"], "url string")
    assert [r["allowed"] for r in ps.robots_verdict(urls, ps.robots_policies(docs)).collect()] == [True] * 3


def test_grammar(spark, web):
    files = {
        "http://first": "User-agent: *\nAllow: /a/b\nDisallow: /a\n",
        "http://star": "User-agent: *\nDisallow: *\nDisallow: /x*\n",
        "http://delay": "User-agent: *\nCrawl-delay: 1.5\n",
        "http://blank": "User-agent: *\n\nDisallow: /\n",
        "http://two": "User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two\n",
        "http://moz": "User-agent: *\nDisallow: /\n\nUser-agent: other\nUser-agent: MOZ\nDisallow: /m\n",
        "http://coded": "User-agent: *\nDisallow: /caf%C3%A9\n",
    }
    cases = {
        "http://first/a/b/c": True, "http://first/a/c": False, "http://star/xyz": True, "http://delay/": True,
        "http://blank/x": True, "http://two/one": False, "http://two/two": True, "http://moz/m": False,
        "http://moz/x": True, "http://coded/café/x": False,
    }
    got = judge(spark, web, files, list(cases))
    assert dict(zip(cases, [allowed for allowed, _ in got])) == cases
    assert {delay for _, delay in got} == {1.0}


def test_random_files_agree_with_the_standard_library(spark, web):
    rng = random.Random(11)
    paths = ["/", "/a", "/a/b", "/a%20b", "*", "", "/?", "/a;", "/?s=", "/a?x=1#f", "/é", "//x", "/50%", "/a+b", "///x"]
    agents = ["*", "moz", "Mozilla", "bot", ""]

    def line() -> str:
        kind = rng.random()
        if kind < 0.3:
            return f"{rng.choice(['User-agent', 'USER-AGENT '])}: {rng.choice(agents)}"
        if kind < 0.75:
            return f"{rng.choice(['Disallow', 'Allow'])}:{rng.choice(paths)}{rng.choice(['', ' # c'])}"
        return rng.choice(["", " ", "Crawl-delay: 2", "Crawl-delay: 1.5", "Request-rate: 1/5", "junk", "foo: bar"])

    files = {f"http://h{i}": rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(0, 12))) for i in range(400)}
    tails = ["", "/", "/a", "/a/b/c", "/a%20b", "/?", "/?s=1", "/a?x=1#f", "/é", "//x", "/50%", "/a;", "?q=1", "/b"]
    urls = [origin + tail for origin in files for tail in rng.sample(tails, 6)]
    expected = []
    for url in urls:
        body = files[re.match(r"http://\w+", url)[0]]
        parser = RobotFileParser()
        parser.allow_all = not body
        if body:
            parser.parse(body.splitlines())
        delay = parser.crawl_delay(AGENT)
        expected.append((parser.can_fetch(AGENT, url), max(float(delay or 0), 1.0)))
    got = judge(spark, web, files, urls)
    assert [(u, g, e) for u, g, e in zip(urls, got, expected) if g != e] == []


def test_rules_and_delays_as_tables(web):
    docs = web(("http://h/robots.txt", "robots", "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /\nCrawl-delay: 4\n\nUser-agent: *\nDisallow:\n"))
    rules = ps.robots_rules(docs).orderBy("group_ord", "rule_ord").collect()
    assert [(r["group_ord"], r["agents"], r["is_default"], r["path"], r["allow"]) for r in rules] == [
        (0, ["a", "b"], False, "/x", False), (0, ["a", "b"], False, "/", True), (1, ["*"], True, "", True),
    ]
    assert [r["delay"] for r in ps.robots_delays(docs).orderBy("group_ord").collect()] == [4.0, None]


def test_long_files_and_a_hot_origin_keep_one_row_per_url(spark, web):
    body = "User-agent: *\n" + "\n".join(f"Disallow: /p{i}/" for i in range(30000))
    urls = [f"http://hot/p{i}/x" for i in range(29990, 30010)] + ["http://cold/x"]
    got = judge(spark, web, {"http://hot": body}, urls)
    assert [allowed for allowed, _ in got] == [False] * 10 + [True] * 11
