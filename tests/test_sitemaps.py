from __future__ import annotations

import presscan as ps
from presscan.operators.ranking import limit_leaves
from presscan.plans.search import Corpus, SearchOptions, scan_entries
from presscan.sources.sitemaps import sitemap_catalog
from tests.conftest import index, titled, urlset
from workloads.derived import documents_table


def entries(web, body):
    rows = ps.sitemap_entries(web(("s", "sitemap", body))).orderBy("entry_ord").collect()
    return [(r["url"], r["title"], r["published_at"], r["image_url"]) for r in rows]


def test_news_urlset(web):
    body = urlset(
        "<loc> https://a.test/1 </loc><news:news><news:publication><news:name>A</news:name></news:publication>"
        "<news:publication_date>2031-02-03T04:05:06Z</news:publication_date><news:title>Uno &amp; dos</news:title>"
        "</news:news><image:image><image:loc>https://i.test/1.jpg</image:loc></image:image>",
        titled("https://a.test/2", "<![CDATA[ Dos <b> ]]>"),
    )
    assert entries(web, body) == [
        ("https://a.test/1", "Uno & dos", "2031-02-03T04:05:06Z", "https://i.test/1.jpg"),
        ("https://a.test/2", "Dos <b>", None, None),
    ]


def test_plain_urlset_and_odd_shapes(web):
    body = urlset(
        "<loc>u1</loc><lastmod>2031-01-01</lastmod>",
        "<loc> </loc>",
        "<lastmod>no loc</lastmod>",
        "<image:image><image:loc>img</image:loc></image:image><loc>u2</loc>",
        "<loc>u3</loc><image>text only</image><news>text only</news>",
        "just text",
        "<loc>u4</loc><news:news><news:title/><news:title>second</news:title></news:news>"
        "<news:news><news:title>other wrapper</news:title></news:news>",
    )
    assert entries(web, body) == [
        ("u1", None, "2031-01-01", None),
        ("u2", None, None, "img"),
        ("u3", None, None, None),
        ("u4", "other wrapper", None, None),
    ]


def test_date_follows_document_order(web):
    news = "<news:news><news:publication_date>N</news:publication_date></news:news>"
    body = urlset(
        f"<loc>a</loc><lastmod>L</lastmod>{news}",
        f"<loc>b</loc><!-- <lastmod> -->{news}<lastmod>L</lastmod>",
        f"<loc>c</loc><lastmod/>{news}",
        "<loc>d</loc><news:news/><lastmod>L</lastmod>",
        f"<loc>e</loc><lastmod/>{news}<lastmod>L</lastmod>",
        f"<loc>f</loc><lastmod> </lastmod><lastmod><![CDATA[ L ]]></lastmod>{news}",
        f"<loc>g</loc><lastmod>L</lastmod><news:news><news:title>publication_date</news:title></news:news>",
    )
    assert [(u, p) for u, _, p, _ in entries(web, body)] == [
        ("a", "L"), ("b", "N"), ("c", "N"), ("d", "L"), ("e", "N"), ("f", "L"), ("g", "L"),
    ]


MALFORMED = ["<not xml", "<broken>", "", "text", "<urlset><url><loc>a</loc></url>", urlset("<loc>a</loc>") + "junk",
             "junk" + urlset("<loc>a</loc>"), "<sitemapindex><sitemap><loc>a</loc></sitemap>"]


def test_malformed_documents_give_nothing(web):
    docs = web(*[(f"d{i}", "sitemap", body) for i, body in enumerate(MALFORMED)])
    assert ps.sitemap_entries(docs).collect() == []
    assert ps.sitemap_children(docs).collect() == []
    assert docs.where(ps.is_sitemap_index("body")).collect() == []


def test_names_count_in_their_own_case(web):
    body = "<URLSET><URL><LOC>a</LOC></URL><url><LOC>b</LOC><loc>c</loc><Lastmod>x</Lastmod><news><Title>t</Title></news></url><url><loc>d</loc><news><title><![CDATA[<LOC>]]></title></news></url></URLSET>"
    assert entries(web, body) == [("c", None, None, None), ("d", "<LOC>", None, None)]
    assert entries(web, "<URLSET><URL><LOC>a</LOC></URL></URLSET>") == []


def test_internal_entities(web):
    declared = '<!DOCTYPE urlset [<!ENTITY site "https://a.test"> <!ENTITY path \'&site;/p\'><!ENTITY path "late"><!ENTITY e "<loc>&path;/2</loc>">]>'
    body = declared + urlset("<loc>&path;/1</loc><news><title><![CDATA[&site;]]> &amp; x</title></news>", "&e;").removeprefix('<?xml version="1.0"?>')
    assert entries(web, body) == [("https://a.test/p/1", "&site; & x", None, None), ("https://a.test/p/2", None, None, None)]
    looped = '<!DOCTYPE u [<!ENTITY a "&b;"><!ENTITY b "&a;">]><u><url><loc>&a;</loc></url></u>'
    laughs = "<!DOCTYPE u [" + '<!ENTITY a0 "lololololol">' + "".join(f'<!ENTITY a{i} "{f"&a{i - 1};" * 10}">' for i in range(1, 10)) + "]><u><url><loc>&a9;</loc></url></u>"
    undeclared = "<!DOCTYPE u [<!ENTITY a 'x'>]><u><url><loc>&b;</loc></url></u>"
    outside = '<!DOCTYPE u [<!ENTITY a SYSTEM "file:///x">]><u><url><loc>&a;</loc></url></u>'
    for bad in (looped, laughs, undeclared, outside):
        assert entries(web, bad) == []


def test_bodies_are_never_sorted_or_sent(spark, web, outlets):
    docs, sites = nested(web), outlets(a=(["https://a.test/root"], []))
    pages = ps.first_page_metadata(ps.article_pages(docs).select("url", "attempt", "body"))
    for rows in (scan_entries(docs, sites), pages, sitemap_catalog(docs)):
        plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [part for part in plan.split("\n\n") if " Sort\n" in part or " Exchange\n" in part]
        assert moved and not [part for part in moved if "body#" in part]


def test_only_reached_sitemaps_are_read(web, outlets):
    sites = outlets(a=(["https://a.test/root"], []))
    others = [(f"https://b{i}.test/s", "sitemap", urlset("<loc>x</loc>")) for i in range(60)]
    corpus = Corpus.over(nested(web, *others))
    asked = []
    facts = Corpus.facts

    def counted(self, urls):
        found = facts(self, urls)
        asked.append(found.count())
        return found

    Corpus.facts = counted
    try:
        assert scanned(corpus, sites) == ["p1", "p2", "p5", "p1", "p2", "p3", "p4"]
    finally:
        Corpus.facts = facts
    assert asked == [1, 3, 3]


def test_a_large_budget_is_added_up_in_ranges(spark):
    """No row is ranked among all of its site: a site's documents span partitions."""
    leaves = spark.range(20_000).selectExpr("0 AS site_ord", "array(int(id)) AS path", "concat('u', id) AS url", "id % 7 AS n_entries")
    total = sum(i % 7 for i in range(20_000))
    rows = limit_leaves(leaves, 50_000)
    assert rows.agg({"take": "sum"}).first()[0] == 50_000 < total
    assert limit_leaves(leaves, 1_000_000).agg({"take": "sum"}).first()[0] == total
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "site_ord" in plan and "_part" in plan


def test_index(web):
    docs = web(
        ("i", "sitemap", "﻿<?xml version='1.0'?><!-- x --><!DOCTYPE sitemapindex>\n" + index("b", " ", "a")),
        ("p", "sitemap", "<s:sitemapindex xmlns:s='x'><s:sitemap><s:loc>c</s:loc></s:sitemap></s:sitemapindex>"),
        ("u", "sitemap", urlset("<loc>x</loc>")),
    )
    assert {r["url"] for r in docs.where(ps.is_sitemap_index("body")).collect()} == {"i", "p"}
    children = ps.sitemap_children(docs).orderBy("source_sitemap", "child_ord").collect()
    assert [(r["source_sitemap"], r["url"]) for r in children] == [("i", "b"), ("i", "a"), ("p", "c")]


def scanned(docs, sites, **options):
    rows = scan_entries(docs, sites, SearchOptions(**options)).orderBy("site_ord", "path", "entry_ord").collect()
    return [r["url"] for r in rows]


def nested(web, *more):
    return web(
        ("https://a.test/root", "sitemap", index("https://a.test/1", "https://a.test/mid", "https://a.test/2", "https://a.test/gone")),
        ("https://a.test/mid", "sitemap", index("https://a.test/3", "https://a.test/deep", "https://a.test/1")),
        ("https://a.test/deep", "sitemap", index("https://a.test/4")),
        ("https://a.test/1", "sitemap", urlset("<loc>p1</loc>", "<loc>p2</loc>")),
        ("https://a.test/2", "sitemap", urlset("<loc>p3</loc>", "<loc>p4</loc>")),
        ("https://a.test/3", "sitemap", urlset("<loc>p5</loc>")),
        ("https://a.test/4", "sitemap", urlset("<loc>too deep</loc>")),
        ("https://a.test/gone", "sitemap", urlset("<loc>error page</loc>"), 1, 500),
        *more,
    )


def test_indexes_open_depth_first_to_a_fixed_depth(web, outlets):
    sites = outlets(a=(["https://a.test/root"], []))
    # A sitemap listed twice is read twice; level three is not read at all.
    assert scanned(nested(web), sites) == ["p1", "p2", "p5", "p1", "p2", "p3", "p4"]


def test_budget_is_per_site_and_spent_in_order(web, outlets):
    sites = outlets(a=(["https://a.test/root"], []), b=(["https://a.test/2"], ["https://a.test/1"]))
    assert scanned(nested(web), sites, max_sitemap_entries=4) == ["p1", "p2", "p5", "p1", "p3", "p4"]
    assert scanned(nested(web), sites, max_sitemap_entries=3, include_archive=True) == ["p1", "p2", "p5", "p3", "p4", "p1"]


def test_disallowed_sitemaps_are_not_read(web, outlets):
    sites = outlets(a=(["https://a.test/root"], []))
    robots = ("https://a.test/robots.txt", "robots", "User-agent: *\nDisallow: /mid\n")
    assert scanned(nested(web, robots), sites) == ["p1", "p2", "p3", "p4"]


def test_catalog_keeps_bodies_out_of_joins(web):
    assert set(sitemap_catalog(nested(web)).columns) == {"url", "fetched_at", "is_index", "children", "n_entries"}


def test_a_catalog_is_read_once_for_all_levels(web, outlets):
    roots = ps.sitemap_roots(outlets(a=(["https://a.test/root"], [])))
    leaves = ps.expand_sitemaps(roots, sitemap_catalog(nested(web)))
    assert "from_xml" not in leaves._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["url"], r["n_entries"]) for r in leaves.collect()) == [
        ("https://a.test/1", 2), ("https://a.test/1", 2), ("https://a.test/2", 2), ("https://a.test/3", 1),
    ]


def test_derived_documents_are_kept_apart_by_kind(spark, tmp_path):
    rows = [(i, f"https://h{i % 2}.test/en/{i}", f"<html><head><title>t{i}</title></head></html>") for i in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    docs = documents_table(spark, str(tmp_path))
    assert docs.columns == ps.DOCUMENT_SCHEMA.names
    # Five pages, two of them tried twice.
    assert docs.where("kind = 'page'").count() == 7
    plan = docs.where("kind = 'sitemap'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_documents_are_parsed_once(web):
    plan = ps.sitemap_children(nested(web))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") <= 1
