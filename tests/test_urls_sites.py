from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pytest
from pyspark.sql import functions as F

import presscan as ps

URLS = [
    "https://user@Host.test:8080/a//b-c_d/?q=1#f",
    "HTTP://h.test",
    "https://h.test/x%C3%A1%2Fy/z%zz+1",
    "/only/path?x",
    "https://h.test/50%25-off/50%",
    "https://h.test/a?b/c#d/e",
    "",
]


def test_parts_follow_the_standard_split(evaluate):
    split = [urlsplit(u) for u in URLS]
    segments = [[s for s in p.path.split("/") if s] for p in split]
    assert evaluate(ps.url_origin("v"), URLS) == [f"{p.scheme}://{p.netloc}" for p in split]
    assert evaluate(ps.path_segments("v"), URLS) == segments
    assert evaluate(ps.last_segment("v"), URLS) == [s[-1] if s else "" for s in segments]


def test_slug_words(evaluate):
    slugs = ["uno-dos_tres", "caf%C3%A9+con-leche", "50%-x", "%e4%zz", "-a-"]
    expected = [unquote(s).replace("-", " ").replace("_", " ").strip() for s in slugs]
    assert evaluate(ps.humanize_slug("v"), slugs) == expected


def verdicts(spark, key, urls):
    site = ps.select_sites(spark, [key])
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").crossJoin(site)
    shaped = rows.select(
        "i",
        ps.is_article_url("url", "host_token", "article_match_on", "article_regex"),
        ps.slug_text("url", "slug_strip_regex"),
    )
    return [tuple(r)[1:] for r in shaped.orderBy("i").collect()]


def test_outlet_with_article_codes(spark):
    got = verdicts(
        spark,
        "elheraldo",
        [
            "https://www.elheraldo.hn/pais/lluvia-en-la-costa-AB12345",
            "https://www.elheraldo.hn/pais/lluvia-en-la-costa-ABCDE12345",
            "https://www.elheraldo.hn/pais",
            "https://notelheraldo.hn/pais/nota-X123Z",
            "https://other.hn/pais/nota-X123",
        ],
    )
    assert [v for v, _ in got] == [True, False, False, True, False]
    assert got[0][1] == "lluvia en la costa"
    assert got[1][1] == "lluvia en la costa ABCDE12345"


def test_outlet_with_dated_permalinks(spark):
    got = verdicts(
        spark,
        "latribuna",
        [
            "https://www.latribuna.hn/2031/02/03/lluvia-en-la-costa/",
            "https://www.latribuna.hn/2031/02/03/",
            "https://www.latribuna.hn/category/pais/",
            "https://www.latribuna.hn/",
            "https://other.hn/2031/02/03/nota",
        ],
    )
    assert [v for v, _ in got] == [True, False, False, False, False]
    assert got[0][1] == "lluvia en la costa"


def test_site_selection(spark):
    assert {r["site_key"] for r in ps.available_sites(spark).collect()} == {"elheraldo", "latribuna"}
    assert ps.select_sites(spark, []).count() == 2
    picked = ps.select_sites(spark, [" LaTribuna", "elheraldo", "latribuna"]).orderBy("site_ord").collect()
    assert [r["site_key"] for r in picked] == ["latribuna", "elheraldo", "latribuna"]
    with pytest.raises(KeyError, match="nope, Nada"):
        ps.select_sites(spark, ["nope", "elheraldo", "Nada"])


def test_roots_in_order(outlets):
    sites = outlets(a=(["n1", "n2"], ["x"]))
    assert [r["url"] for r in ps.sitemap_roots(sites).orderBy("path").collect()] == ["n1", "n2"]
    assert [r["url"] for r in ps.sitemap_roots(sites, True).orderBy("path").collect()] == ["n1", "n2", "x"]


def test_a_new_outlet_is_a_row(outlets, spark):
    sites = outlets(z=([], []))
    url = spark.createDataFrame([("https://z.test/2031/nota",), ("https://z.test/nota",)], "url string")
    hits = url.crossJoin(sites).where(ps.is_article_url("url", "host_token", "article_match_on", "article_regex"))
    assert [r["url"] for r in hits.select(F.col("url")).collect()] == ["https://z.test/2031/nota"]
