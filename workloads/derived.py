"""Web documents derived, inside Spark, from the driver's tables.

Every row of ``pages`` becomes a sitemap entry, an article page and its fetch
attempts; every host becomes a site with an index, a middle index and url-sets
of at most 50 entries, and an archive of the same url-sets, the last ones first. Every
second url-set writes the host as an entity, and all hold elements whose names
differ in case only. The expected answers follow from ``pages`` alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presscan.functions.markup import page_title
from presscan.functions.urls import url_netloc, url_origin
from presscan.schema import DOCUMENT_SCHEMA, KIND_PAGE, KIND_ROBOTS, KIND_SITEMAP
from presscan.session import shared_folder

SET_SIZE = 50
SETS_PER_INDEX = 1000

ARTICLE_SHAPE = r"^/[a-z]{2}/\d+"
SLUG_TAIL = r"\.html$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(text: Column) -> Column:
    """Text as XML or HTML content."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def day(page_id: str = "page_id") -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col(page_id) % 365).cast("int")), "yyyy-MM-dd")


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        "url",
        url_netloc("url").alias("host"),
        F.concat(F.lit("Story "), F.col("page_id"), F.lit(": "), F.coalesce(page_title("html"), F.lit(""))).alias(
            "headline"
        ),
    )


def sites_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per host, in order of first appearance."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_netloc("url").alias("site_key"))
    base = F.concat(F.lit("https://"), F.col("site_key"))
    return pages.groupBy("site_key").agg(F.min("page_id").cast("int").alias("site_ord")).select(
        "site_ord",
        "site_key",
        F.col("site_key").alias("name"),
        base.alias("base_url"),
        F.col("site_key").alias("host_token"),
        F.lit("path").alias("article_match_on"),
        F.lit(ARTICLE_SHAPE).alias("article_regex"),
        F.lit(SLUG_TAIL).alias("slug_strip_regex"),
        F.array(F.concat(base, F.lit("/sitemap.xml"))).alias("news_sitemaps"),
        F.array(F.concat(base, F.lit("/archive.xml"))).alias("archive_sitemaps"),
    )


def _entry_xml() -> Column:
    """Four shapes: news, plain, lastmod before news, news before lastmod."""
    url = escaped(F.col("url"))
    url = F.when(_has_entity(F.col("page_id")), F.replace(url, F.concat(F.lit("//"), F.col("host")), F.lit("&site;"))).otherwise(url)
    loc = F.concat(F.lit("<LOC>https://never.example/</LOC><loc> "), url, F.lit(" </loc>"))
    lastmod = F.concat(F.lit("<lastmod>"), day(), F.lit("</lastmod>"))
    title = F.concat(F.lit("<news:title>"), escaped(F.col("headline")), F.lit("</news:title>"))
    news = F.concat(
        F.lit("<news:news><news:publication><news:name>n</news:name></news:publication><news:publication_date>"),
        day(),
        F.lit("T08:00:00-06:00</news:publication_date>"),
        title,
        F.lit("</news:news>"),
    )
    image = F.concat(F.lit("<image:image><image:loc>https://img.example/"), F.col("page_id"), F.lit(".jpg</image:loc></image:image>"))
    shape = F.col("page_id") % 4
    inner = (
        F.when(shape == 0, F.concat(loc, news, image))
        .when(shape == 1, F.concat(loc, lastmod))
        .when(shape == 2, F.concat(loc, F.lit("<!-- <news:news> -->"), lastmod, news))
        .otherwise(F.concat(image, news, lastmod, loc))
    )
    return F.concat(F.lit("<url>"), inner, F.lit("</url>\n"))


def _document(url: Column, kind: str, body: Column, attempt: Column | int = 1, status: Column | int = 200) -> list[Column]:
    as_column = lambda v: F.lit(v) if isinstance(v, int) else v
    return [
        url.alias("url"),
        F.lit(kind).alias("kind"),
        as_column(attempt).cast("int").alias("attempt"),
        as_column(status).cast("int").alias("status"),
        body.alias("body"),
        F.lit("2026-06-16 00:00:00").cast("timestamp").alias("fetched_at"),
    ]


def _joined(group: DataFrame, keys: list[str], order: str, text: str, head: str | Column, tail: str) -> DataFrame:
    """Bodies of at most about a thousand short parts each, in order; ``head`` may use the keys."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    body = F.array_join(F.transform(parts, lambda p: p[text]), "")
    head = F.lit(head) if isinstance(head, str) else head
    return group.groupBy(*keys).agg(body.alias("body")).withColumn("body", F.concat(head, "body", F.lit(tail)))


def _has_entity(page_id: Column) -> Column:
    return F.floor(page_id / SET_SIZE) % 2 == 1


def url_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = titled_pages(spark, sf_dir).select(
        "host", "page_id", F.floor(F.col("page_id") / SET_SIZE).alias("set_no"), _entry_xml().alias("xml")
    )
    entity = F.concat(F.lit('<!DOCTYPE urlset [\n<!ENTITY site "//&name;"> <!ENTITY name "'), F.col("host"), F.lit('">\n]>\n'))
    head = (
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" '
        'xmlns:news="http://www.google.com/schemas/sitemap-news/0.9" '
        'xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">\n'
    )
    with_entity = F.when(_has_entity(F.col("set_no") * SET_SIZE), entity).otherwise(F.lit(""))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), with_entity, F.lit(head))
    sets = _joined(pages, ["host", "set_no"], "page_id", "xml", head, "<URL><loc>https://never.example/</loc></URL></urlset>\n")
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemaps/"), F.col("set_no"), F.lit(".xml"))
    return sets.select("host", "set_no", *_document(url, KIND_SITEMAP, F.col("body")))


def _index(children: DataFrame, keys: list[str]) -> DataFrame:
    listed = children.withColumn("xml", F.concat(F.lit("<sitemap><loc>"), escaped(F.col("child")), F.lit("</loc></sitemap>\n")))
    return _joined(listed, keys, "child_no", "xml", "<sitemapindex>\n", "</sitemapindex>")


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: ``sitemap.xml`` -> ``index/N.xml`` -> ``sitemaps/N.xml``, and the same behind ``archive.xml``."""
    sets = url_sets(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(
        url_netloc("url").alias("host"), F.floor(F.col("page_id") / SET_SIZE).alias("set_no")
    )
    numbered = pages.distinct().withColumn("index_no", F.floor(F.col("set_no") / SETS_PER_INDEX))
    base = F.concat(F.lit("https://"), F.col("host"))

    def indexes(root: str, middle: str, leaf: str, sign: int) -> DataFrame:
        """The root and middle indexes; ``sign`` -1 lists what has the highest number first."""
        listed = numbered.select(
            "host", "index_no", (sign * F.col("set_no")).alias("child_no"),
            F.concat(base, F.lit(f"/{leaf}/"), F.col("set_no"), F.lit(".xml")).alias("child"),
        )
        tops = numbered.select("host", "index_no").distinct().select(
            "host", (sign * F.col("index_no")).alias("child_no"),
            F.concat(base, F.lit(f"/{middle}/"), F.col("index_no"), F.lit(".xml")).alias("child"),
        )
        middle_url = F.concat(base, F.lit(f"/{middle}/"), F.col("index_no"), F.lit(".xml"))
        middles = _index(listed, ["host", "index_no"]).select(*_document(middle_url, KIND_SITEMAP, F.col("body")))
        return middles.unionByName(_index(tops, ["host"]).select(*_document(F.concat(base, F.lit(f"/{root}.xml")), KIND_SITEMAP, F.col("body"))))

    archived = sets.withColumn("url", F.replace("url", F.lit("/sitemaps/"), F.lit("/archive/")))
    return (
        sets.unionByName(archived)
        .drop("host", "set_no")
        .unionByName(indexes("sitemap", "index", "sitemaps", 1))
        .unionByName(indexes("archive", "archive-index", "archive", -1))
    )


def robots_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file per origin, of a shape given by the length of the host.

    Some origins answer with an error, and some forbid their url-sets.
    """
    pages = table(spark, sf_dir, "pages").select(url_netloc("url").alias("host"), url_origin("url").alias("origin"))
    sitemap_origins = pages.select("host", F.concat(F.lit("https://"), F.col("host")).alias("origin"))
    origins = pages.unionByName(sitemap_origins).distinct()
    size = F.length("host")
    body = (
        F.when(
            size % 3 == 0,
            F.lit("User-agent: *\nDisallow: /de/\nAllow: /es/1\nDisallow: /es/\nDisallow: *\nCrawl-delay: 2\n"),
        )
        .when(
            size % 3 == 1,
            F.lit(
                "# rules\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: moz\nUser-agent: zilla\n"
                "Disallow: /%66r/\nCrawl-delay: 1.5\n\nUser-agent: *\nDisallow: /en/\n"
            ),
        )
        .otherwise(F.lit("User-agent: *\nDisallow: /sitemaps/\nDisallow:\nDisallow: /\n"))
    )
    status = F.when(size % 5 == 0, 404).otherwise(200)
    return origins.select(
        *_document(F.concat(F.col("origin"), F.lit("/robots.txt")), KIND_ROBOTS, body, 1, status)
    )


def _injected() -> Column:
    """Metadata put into the page's head, four shapes."""
    as_json = F.to_json(
        F.struct(
            F.lit("NewsArticle").alias("@type"),
            F.col("headline").alias("headline"),
            F.concat(F.lit("From "), F.col("host")).alias("description"),
            F.array(F.struct(F.concat(F.lit(" Reporter "), F.col("page_id") % 10).alias("name"))).alias("author"),
            F.concat(day(), F.lit("T10:00:00Z")).alias("datePublished"),
            F.array(F.concat(F.lit("https://img.example/ld/"), F.col("page_id"))).alias("image"),
        )
    )
    ld = F.concat(
        F.lit('<script type="application/ld+json">'), F.replace(as_json, F.lit("<"), F.lit("\\u003c")), F.lit("</script>")
    )
    og = F.concat(
        F.lit('<meta property="og:title" content="'), escaped(F.col("headline")),
        F.lit('"><meta name=author content="/staff/-/list"><meta property=\'og:image\' content="https://img.example/og/'),
        F.col("page_id"), F.lit('"/><meta property="article:published_time" content="not a date">'),
    )
    shape = F.col("page_id") % 4
    return F.when(shape == 0, ld).when(shape == 1, og).when(shape == 2, F.concat(og, ld)).otherwise(F.lit(""))


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: a third of the pages fail first, a seventh always."""
    pages = titled_pages(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    html = F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), _injected()))
    tries = F.when(F.col("page_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    # In one select with a generator the struct above would lose its field names.
    attempts = pages.select("page_id", "url", html.alias("_html")).withColumn("_try", F.explode(tries))
    failed = (F.col("page_id") % 7 == 0) | ((F.col("page_id") % 3 == 0) & (F.col("_try") == 1))
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    return attempts.select(
        *_document(F.col("url"), KIND_PAGE, F.when(~failed, F.col("_html")), F.col("_try"), status)
    )


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (robots_documents, sitemap_documents, page_documents)
    first, *rest = [p(spark, sf_dir) for p in parts]
    for part in rest:
        first = first.unionByName(part)
    return first.select(*DOCUMENT_SCHEMA.names)


def article_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as article pages, in six metadata shapes, whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    name = F.concat(F.lit("Writer "), F.col("source"))
    person = F.struct(F.lit("Person").alias("@type"), name.alias("name"))

    def ld(block: Column) -> Column:
        return F.concat(
            F.lit("<script data-x='1' type=\"application/ld+json\"> "),
            F.replace(block, F.lit("<"), F.lit("\\u003c")),
            F.lit("\n</script>"),
        )

    def meta(attr: str, key: str, content: Column) -> Column:
        return F.concat(F.lit(f'<meta {attr}="{key}" content="'), escaped(content), F.lit('">'))

    iso = F.concat(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd"),
        F.lit("T12:30:00-06:00"),
    )
    rfc = F.concat(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "EEE, dd MMM yyyy"),
        F.lit(" 12:30:00 GMT"),
    )
    image = F.concat(F.lit("https://img.example/"), F.col("doc_id"))
    listed = F.to_json(
        F.array(
            F.struct(
                F.lit("NewsArticle").alias("@type"),
                F.concat(F.lit("Listed "), F.col("doc_id")).alias("headline"),
                F.col("text").alias("description"),
                F.array(F.array(F.array(F.array(person), F.array(person)))).alias("author"),
                F.array(F.array(F.array(F.array(F.struct(F.lit(" ").alias("url"), image.alias("contentUrl")))))).alias("image"),
                iso.alias("datePublished"),
            )
        )
    )
    listed = F.concat(F.lit("[" * 6), listed, F.lit("]" * 6))
    graph = F.to_json(
        F.struct(
            F.array(
                F.struct(F.lit("WebPage").alias("@type"), F.lit("page").alias("name"), F.lit(None).cast("string").alias("headline")),
                F.struct(F.lit("Article").alias("@type"), F.lit(None).cast("string").alias("name"),
                         F.concat(F.lit("Graph "), F.col("doc_id")).alias("headline")),
            ).alias("@graph")
        )
    )
    siblings = F.to_json(
        F.transform(
            F.array(F.lit("first"), F.lit("last")),
            lambda which: F.struct(
                F.array(F.lit("Thing"), F.lit("NewsArticle")).alias("@type"),
                F.concat(which, F.lit(" "), F.col("doc_id")).alias("headline"),
            ),
        )
    )
    junk = F.to_json(
        F.struct(
            F.lit("Article").alias("@type"),
            F.concat(F.lit("Junk "), F.col("doc_id")).alias("headline"),
            F.lit("/people/x").alias("author"),
            F.lit("soon").alias("datePublished"),
            image.alias("thumbnailUrl"),
        )
    )
    shape = F.col("doc_id") % 6
    head = (
        F.when(shape == 0, F.concat(meta("property", "og:title", F.lit("loses")), meta("property", "og:image", F.concat(image, F.lit("/og"))), ld(listed)))
        .when(shape == 1, F.concat(ld(graph), meta("name", "author", name), meta("property", "og:description", F.col("text")), meta("property", "article:published_time", iso)))
        .when(shape == 2, F.concat(F.lit("<!--"), meta("name", "author", F.lit("hidden")), F.lit("-->"), meta("itemprop", "author", F.lit("/x/y")), meta("name", "byl", name), meta("property", "og:title", F.concat(F.lit('Say "hi" & <bye> '), F.col("doc_id"))), meta("name", "description", F.col("text")), meta("name", "date", rfc), meta("name", "twitter:image", image)))
        .when(shape == 3, F.lit("<script>var m = '<meta name=\"author\" content=\"scripted\">';</script>"))
        .when(shape == 4, F.concat(ld(F.lit("{not json")), ld(siblings), ld(F.lit('"scalar"'))))
        .otherwise(F.concat(ld(junk), meta("property", "article:published_time", iso), meta("name", "byl", name)))
    )
    body = F.concat(
        F.lit("<!DOCTYPE html><html><head><title> Document\n"), F.col("doc_id"), F.lit(" </title>"), head,
        F.lit("</head><body><p>"), escaped(F.col("text")), F.lit("</p></body></html>"),
    )
    return docs.select("doc_id", body.alias("html"))


_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def written(spark: SparkSession, sf_dir: str, name: str, make, by: tuple[str, ...] = ()) -> DataFrame:
    """A derived table, written once per application to the shared folder, in a folder for each value of ``by``.

    Engines read documents from storage; deriving them is not part of a query.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/derived/{uuid.uuid4().hex}/{name}"
        made = make(spark, sf_dir)
        made.write.partitionBy(*by).parquet(path)
        _WRITTEN[key] = path, made.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitioned by kind: a scan of sitemaps is dealt out by their bytes, not by those of the pages beside them."""
    return written(spark, sf_dir, "web_documents", all_documents, by=("kind",))


def sites_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "sites", sites_of)


def article_pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir, "article_html", article_html)
