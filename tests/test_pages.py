from __future__ import annotations

import html as stdlib_html
import json
import random

from pyspark.sql import functions as F

import presscan as ps
from presscan.functions.jsonld import jsonld_nodes


def metadata(spark, *pages: str) -> list[tuple]:
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [tuple(r)[1:] for r in ps.page_metadata(rows).orderBy("i").collect()]


def ld(*blocks) -> str:
    return "".join(
        f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in blocks
    )


def meta(**tags) -> str:
    return "".join(f'<meta property="{k.replace("__", ":")}" content="{v}">' for k, v in tags.items())


ARTICLE = {
    "@type": "NewsArticle",
    "headline": "Gana el equipo",
    "description": "Una tarde",
    "datePublished": "2031-02-03T04:05:06-06:00",
    "author": [{"@type": "Person", "name": "Redactora"}],
    "image": ["https://i.test/a.jpg", "https://i.test/b.jpg"],
}


def test_jsonld_wins_but_not_for_the_image(spark):
    page = meta(og__title="loses", author="/tema/-/x", og__image="https://i.test/og.jpg") + ld([{"@type": "BreadcrumbList"}, ARTICLE])
    assert metadata(spark, page, page.replace("og:image", "x:image")) == [
        ("Gana el equipo", "Una tarde", "Redactora", "2031-02-03T04:05:06-06:00", "https://i.test/og.jpg"),
        ("Gana el equipo", "Una tarde", "Redactora", "2031-02-03T04:05:06-06:00", "https://i.test/a.jpg"),
    ]


def test_author_reference_falls_back_to_meta(spark):
    graph = {"@graph": [{"@type": "WebPage", "name": "page"}, {"@type": "Article", "headline": "H", "author": {"@id": "#p"}}, {"@type": "Person", "@id": "#p", "name": "P"}]}
    page = ld(graph) + meta(author="Ana Web", article__published_time="2031-02-03T00:00:00+00:00")
    assert metadata(spark, page) == [("H", None, "Ana Web", "2031-02-03T00:00:00+00:00", None)]


def test_empty_and_malformed_pages(spark):
    assert metadata(spark, "", "<p>text", ld("{not json") + meta(og__title="T")) == [
        (None,) * 5, (None,) * 5, ("T", None, None, None, None),
    ]


def test_first_values_are_not_retried(spark):
    page = meta(author="/x", byl="Ana", article__published_time="soon", date="2031-02-03")
    assert metadata(spark, page) == [(None,) * 5]


def titles(spark, *blocks):
    return [m[0] for m in metadata(spark, *[ld(*b) for b in blocks])]


def test_choice_of_the_article_node(spark):
    def node(kind, name):
        return {"@type": kind, "headline": name}

    assert titles(
        spark,
        [[node("NewsArticle", "first"), node("NewsArticle", "last")]],
        [node("NewsArticle", "one"), node("NewsArticle", "two")],
        [node("Report", "r"), node("blogposting", "b"), node("ARTICLE", "a")],
        [node(["Thing", "ReportageNewsArticle"], "list"), node("Article", "a")],
        [[[node("Article", "nested")]]],
        [{"@type": "Other", "mainEntity": node("Article", "hidden")}],
        [{"@type": "Article", "headline": "outer", "@graph": [node("Article", "inner")]}],
        ['{"@type":"Article","headline":"a","headline":"b"}'],
        [{"@type": "Article", "headline": 5, "name": "name"}, node("Article", "second")],
    ) == ["last", "one", "a", "list", "nested", None, "outer", "b", "name"]


AUTHORS = [
    (" Ana ", "Ana"), ({"name": "Ana"}, "Ana"), ({"name": 3}, None), (["Ana", {"name": "Eva"}, "Ana", 7, None], "Ana, Eva"),
    ("/people/ana", None), ("https://x/ana", None), ("a/b", None), ("Ana / Eva", "Ana / Eva"), ([], None), (7, None),
    ([["Ana", "Eva"], "Ana"], "Ana, Eva, Ana"),
]
IMAGES = [("u", "u"), ({"url": " ", "contentUrl": "c"}, "c"), ([{"x": 1}, [" "], "u"], "u"), ([], None), (3, None)]


def test_author_and_image_shapes(spark):
    authors = metadata(spark, *[ld({**ARTICLE, "author": a}) for a, _ in AUTHORS])
    assert [m[2] for m in authors] == [e for _, e in AUTHORS]
    images = metadata(spark, *[ld({**ARTICLE, "image": i}) for i, _ in IMAGES])
    assert [m[4] for m in images] == [e for _, e in IMAGES]


def test_markup_that_is_not_markup(spark):
    page = """<!-- <meta name="author" content="hidden"> --><script>var m='<meta name="author" content="js">'</script>
      <noscript><meta name="author" content="off"></noscript><template><meta name="author" content="tpl"></template>
      <textarea><title>no</title></textarea><TITLE lang=es> Uno &amp;
        dos</TITLE><svg><title>icon</title></svg><META content='d"d > e' NAME=description /><meta name=author content=Ana>
      <meta name="author" content="second"><meta property="" itemprop="date" content="2031-02-03"><meta name="og:image" content="">
      <script type='APPLICATION/LD+JSON'>\n</script><meta property=og:image content=https://i.test/x?a=1&b=2>"""
    assert metadata(spark, page) == [("Uno & dos", 'd"d > e', "Ana", "2031-02-03T00:00:00", "https://i.test/x?a=1&b=2")]


def test_very_large_pieces_need_no_stack(spark):
    big = "x" * 300_000
    pages = [f"<title>{big}</title>", f"<title>t</title ><meta name=a content='{big}'>", "<script>" + "a\n" * 150_000, "<!--" + "-" * 200_000]
    assert [m[0] for m in metadata(spark, *pages)] == [big, "t", None, None]


def test_character_references(evaluate):
    rng = random.Random(3)
    parts = ["&amp;", "&amp", "&lt", "&ltfoo", "&notit;", "&ntilde;", "&#39;", "&#x27", "&#128;", "&#0;", "&#xD800;", "&#1114112;",
             "&bogus;", "&", "&#", "&NotEqualTilde;", "&eacute", "&#99999999999999;", " x", "é", "&copy=1", "&fjlig;"]
    values = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(1500)]
    assert evaluate(ps.unescape_html("v"), values) == [stdlib_html.unescape(v) for v in values]


def test_references_in_attributes_keep_query_strings(evaluate):
    values = ["?a=1&copy=2&lt;", "?a&copyx", "caf&eacute", "&amp;amp;"]
    assert evaluate(ps.unescape_html("v", True), values) == ["?a=1&copy=2<", "?a&copyx", "café", "&amp;"]


def test_nodes_in_order(spark):
    blocks = ['[{"a":1},{"b":2,"@graph":[{"c":3},[{"d":4}],"x"]}]', "{bad", '"s"', '{"e":5} junk', '{"@graph":{"f":6}}', "null"]
    row = spark.createDataFrame([(blocks,)], "b array<string>")
    keys = F.transform(jsonld_nodes("b"), lambda n: F.to_json(n["v"]))
    assert row.select(keys).first()[0] == [
        '{"@graph":[{"c":3},[{"d":4}],"x"],"b":2}', '{"d":4}', '{"c":3}', '{"a":1}', '{"@graph":{"f":6}}',
    ]


def test_nesting_has_no_bound(spark):
    def deep(lists: int, graphs: int) -> str:
        node: object = {"@type": "NewsArticle", "headline": "h", "author": [[[[["A", " "], {"name": "B"}], "A"]]], "image": [[[[{"url": "u"}]]]]}
        for _ in range(lists):
            node = [node]
        for _ in range(graphs):
            node = {"@graph": [node]}
        return f'<script type="application/ld+json">{json.dumps(node)}</script>'

    found = metadata(spark, *[deep(*n) for n in ((0, 0), (7, 0), (0, 6), (12, 12))])
    assert {(m[0], m[2], m[4]) for m in found} == {("h", "A, B, A", "u")}
