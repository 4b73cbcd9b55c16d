from __future__ import annotations

from datetime import datetime, timedelta

import pytest

import presscan as ps
from tests.conftest import index, titled, urlset

NOW = "2031-02-03T04:05:06+00:00"
BLOCKS = "User-agent: *\nDisallow: /secreto\nDisallow: /oculto\n"


@pytest.fixture
def arrive(spark, tmp_path):
    """Adds documents (url, kind, body) or (url, kind, body, status) as one file of a day."""

    def add(day: int, *rows: tuple) -> None:
        at = datetime(2031, 1, 1) + timedelta(days=day)
        full = [(r[0], r[1], 1, r[3] if len(r) > 3 else 200, r[2], at) for r in rows]
        spark.createDataFrame(full, ps.DOCUMENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return add


@pytest.fixture
def articles(spark, tmp_path):
    """Titles by URL (and keyword) after all that has arrived."""

    def run(sites, keywords="café", **options):
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        stream = ps.stream_documents(spark, str(tmp_path / "in"), files_per_batch=1)
        ps.stream_articles(stream, sites, keywords, out, state, scraped_at=NOW, **options).awaitTermination()
        rows = ps.articles_table(spark, out).read().collect()
        return {r["url"] if isinstance(keywords, str) else (r["url"], r["keyword"]): r["title"] for r in rows}

    return run


@pytest.fixture
def entries(spark, tmp_path):
    def run(sites, keywords="cafe", **options):
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        stream = ps.stream_documents(spark, str(tmp_path / "in"), files_per_batch=1)
        ps.stream_entries(stream, sites, keywords, out, state, **options).awaitTermination()
        return sorted(r["url"] for r in ps.read_entries(spark, out).collect())

    return run


def test_entries_and_pages_arrive_in_any_order(arrive, articles, outlets):
    sites = outlets(a=(["https://a.test/s", "https://a.test/s2"], []))
    arrive(1, ("https://a.test/s", "sitemap", urlset(titled("u1", "Café uno"), titled("u2", "Café dos"))),
           ("u3", "page", "<title>Café tres, página</title>"))
    assert articles(sites) == {"u1": "Café uno", "u2": "Café dos"}
    arrive(2, ("u1", "page", "<title>Café uno, página</title>"), ("u2", "page", "<title>Sin ella</title>"),
           ("https://a.test/s2", "sitemap", urlset(titled("u3", "Café tres"))))
    assert articles(sites) == {"u1": "Café uno, página", "u3": "Café tres, página"}
    assert articles(sites) == {"u1": "Café uno, página", "u3": "Café tres, página"}


def test_a_late_robots_file_still_decides(arrive, articles, outlets):
    sites = outlets(a=(["https://a.test/s", "https://a.test/oculto"], []))
    arrive(1, ("https://a.test/s", "sitemap", urlset(titled("https://a.test/uno", "Café"), titled("https://a.test/secreto", "Café"))),
           ("https://a.test/oculto", "sitemap", urlset(titled("https://a.test/dos", "Café"), titled("https://a.test/uno", "Otro café"))))
    assert set(articles(sites)) == {"https://a.test/uno", "https://a.test/dos", "https://a.test/secreto"}
    arrive(2, ("https://a.test/robots.txt", "robots", BLOCKS))
    assert articles(sites) == {"https://a.test/uno": "Café"}


def test_an_index_may_come_after_its_url_sets(arrive, articles, outlets):
    """Sitemaps may lie elsewhere; what no root leads to is not read, archives only if asked for."""
    sites = outlets(a=(["https://a.test/i"], ["https://a.test/archive"]), b=(["https://cdn.test/b"], []))
    arrive(1, ("https://cdn.test/a", "sitemap", urlset(titled("u1", "Café"))), ("https://cdn.test/b", "sitemap", urlset(titled("u2", "Café"))),
           ("https://a.test/archive", "sitemap", urlset(titled("u3", "Café"))), ("https://a.test/stray", "sitemap", urlset(titled("u4", "Café"))))
    assert set(articles(sites)) == {"u2"}
    arrive(2, ("https://a.test/i", "sitemap", index("https://cdn.test/a")))
    assert set(articles(sites)) == {"u1", "u2"}
    arrive(3, ("u9", "page", "<title>x</title>"))
    assert set(articles(sites, include_archive=True)) == {"u1", "u2", "u3"}


def test_several_keywords_and_a_table_of_them(spark, arrive, articles, outlets):
    sites = outlets(a=(["https://a.test/s"], []))
    arrive(1, ("https://a.test/s", "sitemap", urlset(titled("u1", "Café y té"), titled("u2", "Té"))))
    table = spark.createDataFrame([("café",), ("TE",)], "keyword string")
    assert set(articles(sites, table)) == {("u1", "café"), ("u1", "TE"), ("u2", "TE")}
    arrive(2, ("u1", "page", "<title>Solo té</title>"))
    assert set(articles(sites, ["café", "TE"])) == {("u1", "TE"), ("u2", "TE")}


def test_an_entry_is_passed_on_once_however_late(arrive, entries, outlets):
    sites = outlets(a=(["https://a.test/s1", "https://a.test/s2", "https://a.test/s3"], []))
    arrive(100, ("https://a.test/robots.txt", "robots", None, 404))
    for n, day in enumerate((100, 103, 60), 1):  # the last one is forty days late
        arrive(day, (f"https://a.test/s{n}", "sitemap", urlset(titled("https://a.test/1", "Café"), titled(f"https://a.test/n{n}", "Café"), titled("https://a.test/x", "Té"))))
    expected = [f"https://a.test/{e}" for e in ("1", "n1", "n2", "n3")]
    assert entries(sites) == expected
    arrive(104, ("https://a.test/s1", "sitemap", urlset(titled("https://a.test/1", "Café"))))
    assert entries(sites) == expected


def test_entries_wait_for_their_robots_file(arrive, entries, outlets):
    sites = outlets(a=(["https://a.test/s", "https://a.test/oculto"], []))
    arrive(1, ("https://a.test/s", "sitemap", urlset(titled("https://a.test/uno", "Café"), titled("https://a.test/secreto", "Café"), titled("https://b.test/dos", "Café"))),
           ("https://a.test/oculto", "sitemap", urlset(titled("https://a.test/tres", "Café"))))
    assert entries(sites) == []
    arrive(2, ("https://a.test/robots.txt", "robots", BLOCKS))
    assert entries(sites) == ["https://a.test/uno"]
    arrive(3, ("https://b.test/robots.txt", "robots", "", 500))
    assert entries(sites) == ["https://a.test/uno", "https://b.test/dos"]


def test_a_repeated_batch_changes_nothing(spark, arrive, outlets, tmp_path):
    from presscan.streaming.crawl import Crawl

    crawl = Crawl(spark, str(tmp_path / "crawl"), outlets(a=(["https://a.test/s"], [])), "café")
    arrive(1, ("https://a.test/s", "sitemap", urlset(titled("u1", "Café"))))
    batch = spark.read.schema(ps.DOCUMENT_SCHEMA).parquet(str(tmp_path / "in"))
    first, again = (crawl.take(batch, ("q", 0)).standing.collect() for _ in range(2))
    assert [r["url"] for r in first] == ["u1"] and first == again
    assert crawl.take(batch, ("q", 1)).standing.count() == 0
    assert crawl.candidates.read().count() == 1
