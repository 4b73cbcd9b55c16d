from __future__ import annotations

from datetime import datetime, timezone

import pytest

import presscan as ps
from presscan.plans.search import Corpus
from tests.conftest import index, titled, urlset

NOW = datetime(2031, 2, 3, 4, 5, 6, 789, timezone.utc)


def page(title: str, description: str = "") -> str:
    return f'<title>{title}</title><meta name="description" content="{description}">'


@pytest.fixture
def world(web, outlets):
    """Two outlets; one index, one robots file, pages of every kind."""
    docs = web(
        ("https://a.test/robots.txt", "robots", "User-agent: *\nDisallow: /2031/secreto"),
        ("https://a.test/s", "sitemap", index("https://a.test/s1", "https://a.test/s2")),
        ("https://a.test/s1", "sitemap", urlset(
            titled("https://a.test/uno", "Café de olla"),
            titled("https://a.test/dos", "Otra cosa"),
            "<loc>https://a.test/2031/cafe-frio/</loc><lastmod>2031-01-01</lastmod>",
            "<loc>https://a.test/seccion/cafe</loc>",
            titled("https://a.test/2031/secreto", "Café secreto"),
        )),
        ("https://a.test/s2", "sitemap", urlset(titled("https://a.test/uno", "Café repetido"), titled("https://a.test/tres", "CAFE tres"))),
        ("https://b.test/s", "sitemap", urlset(
            titled("https://a.test/dos", "Café visto por B"),
            titled("https://b.test/solo", "Solo café") .replace("</news:title>", "</news:title><news:publication_date>2031-01-05</news:publication_date>"),
        )),
        ("https://a.test/uno", "page", page("Historia del caf&eacute;"), 1, 404),
        ("https://a.test/dos", "page", page("Sin la palabra")),
        ("https://a.test/2031/cafe-frio/", "page", page("", "")),
        ("https://a.test/tres", "page", None, 1, 0),
        ("https://a.test/tres", "page", None, 2, 0),
        ("https://a.test/tres", "page", page("Tres", "con cafe"), 3, 200),
        ("https://a.test/tres", "page", page("Cuarto intento, café"), 4, 200),
    )
    return docs, outlets(a=(["https://a.test/s"], []), b=(["https://b.test/s"], []))


def test_discovery_keeps_the_first_match(world):
    found = ps.discover(*world, "CAFÉ").orderBy("site_ord", "path", "entry_ord").collect()
    assert [(r["site_key"], r["url"], r["title"]) for r in found] == [
        ("a", "https://a.test/uno", "Café de olla"),
        ("a", "https://a.test/2031/cafe-frio/", None),
        ("a", "https://a.test/2031/secreto", "Café secreto"),
        ("a", "https://a.test/tres", "CAFE tres"),
        # Not a match in outlet a, so still open to outlet b.
        ("b", "https://a.test/dos", "Café visto por B"),
        ("b", "https://b.test/solo", "Solo café"),
    ]


def test_whole_search(world):
    articles = {r["url"]: r.asDict() for r in ps.search(*world, "café", NOW).collect()}
    assert set(articles) == {"https://a.test/uno", "https://a.test/tres", "https://b.test/solo"}
    assert list(articles["https://b.test/solo"]) == list(ps.ARTICLE_FIELDS)
    assert articles["https://a.test/uno"]["title"] == "Historia del café"  # error pages count
    assert articles["https://a.test/tres"]["title"] == "Tres"  # third attempt is the last
    solo = articles["https://b.test/solo"]  # no page at all: sitemap data
    assert (solo["source"], solo["title"], solo["published_at"]) == ("b", "Solo café", "2031-01-05T00:00:00")
    assert (solo["keyword"], solo["scraped_at"]) == ("café", "2031-02-03T04:05:06+00:00")


def test_cap_counts_candidates_not_articles(world):
    options = ps.SearchOptions(max_articles=4)
    assert {r["url"] for r in ps.search(*world, "café", NOW, options).collect()} == {
        "https://a.test/uno", "https://b.test/solo",
    }
    assert ps.search(*world, "café", NOW, ps.SearchOptions(max_articles=0)).count() == 1  # floored at one


def test_several_keywords_match_their_own_search(world):
    docs, sites = world
    corpus = Corpus.of(docs)
    together = ps.search_many(corpus, sites, ["café", "cosa", "cafe tres"], NOW).collect()
    for keyword in ("café", "cosa", "cafe tres"):
        alone = {tuple(r) for r in ps.search(corpus, sites, keyword, NOW).collect()}
        assert {tuple(r) for r in together if r["keyword"] == keyword} == alone


def test_funnel(world):
    rows = {r["site_key"]: r.asDict() for r in ps.funnel(*world, "café").collect()}
    assert rows["a"] == {"site_key": "a", "scanned": 7, "matched": 4, "robots": 1, "no_title": 1, "keyword": 0, "resolved": 2}
    assert rows["b"] == {"site_key": "b", "scanned": 2, "matched": 2, "robots": 0, "no_title": 0, "keyword": 1, "resolved": 1}


def test_empty_keyword_is_refused(world):
    with pytest.raises(ValueError):
        ps.search(*world, "  ", NOW)


def test_listing(spark):
    rows = [("a", "T", None, "Ana", "", None, "u", "k", "s"), ("b", "U", None, None, "2031-01-01", None, "v", "k", "s")]
    report = ps.article_report(spark.createDataFrame(rows, ps.ARTICLE_SCHEMA)).orderBy("source")
    assert [tuple(r) for r in report.collect()] == [
        ("a", "(no date)", "T", "Ana", "u"), ("b", "2031-01-01", "U", "(no author)", "v"),
    ]


def test_pages_are_narrowed_before_they_are_parsed(world, spark):
    from presscan.plans.search import SearchOptions, candidate_metadata
    from presscan.session import stored

    docs, _ = world
    candidates = stored(spark.createDataFrame([("https://a.test/uno",)], "url string"))
    plan = candidate_metadata(docs, candidates, SearchOptions())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert plan.index("regexp_extract_all") < plan.index("LeftSemi")  # plans are printed top down
    logical = candidate_metadata(docs, candidates, SearchOptions())._jdf.queryExecution().logical().toString()
    assert "broadcast" not in logical.lower()


def test_plan_does_not_grow_with_keywords(web, outlets):
    from presscan.operators.matching import match_entries

    entries = web(("https://a.test/2031/x", "sitemap", "")).selectExpr("0 AS site_ord", "url", "'Uno dos' AS title")
    plans = []
    for n in (2, 400):
        found = match_entries(entries, outlets(a=([], [])), ["uno DOS", *[f"k{i}" for i in range(n)]])
        assert [r["keyword"] for r in found.collect()] == ["uno DOS"]
        plans.append(len(found._jdf.queryExecution().analyzed().toString()))
    assert plans[1] < plans[0] + 40_000


def test_a_keyword_table_finds_what_the_list_finds(spark, world, web):
    words = ["CAFÉ", "cafe  frio", "é", "o", "secreto café", "ausente", "ca fe", "é", "solo CAFÉ solo", "xyz cafe", "́"]
    table = spark.createDataFrame([(w, 1) for w in words], "keyword string, site_ord int")
    columns = ["keyword", "site_key", "url", "title"]
    expected = ps.discover(*world, list(dict.fromkeys(words))).select(*columns).collect()
    found = ps.discover(*world, table).select(*columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected)) and len(expected) > 10
    articles = ps.search_many(*world, table.where("keyword <> '́'"), NOW).collect()
    assert sorted(map(repr, articles)) == sorted(map(repr, ps.search_many(*world, [w for w in dict.fromkeys(words) if w != "́"], NOW).collect()))


def test_a_large_keyword_table_joins_by_key(spark, world):
    table = spark.range(10_000).selectExpr("concat('palabra ', id) AS keyword").union(spark.createDataFrame([("café 1",), ("tres",)], "keyword string"))
    found = ps.discover(*world, table)
    assert {(r["keyword"], r["url"]) for r in found.collect()} == {("tres", "https://a.test/tres")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keyword_tables_without_words(spark, world):
    blank = spark.createDataFrame([("café",), (" ",)], "keyword string")
    with pytest.raises(ValueError, match="empty"):
        ps.search_many(*world, blank)
    assert ps.search_many(*world, blank.limit(0)).count() == 0
