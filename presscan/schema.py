"""Record layouts and data-affecting defaults shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical article column order.
ARTICLE_FIELDS = (
    "source",
    "title",
    "description",
    "author",
    "published_at",
    "image_url",
    "url",
    "keyword",
    "scraped_at",
)

ARTICLE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ARTICLE_FIELDS])

#: Already-fetched web documents: robots files, sitemaps and HTML pages.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

KIND_ROBOTS = "robots"
KIND_SITEMAP = "sitemap"
KIND_PAGE = "page"

# Run defaults that change results.
MAX_ARTICLES = 40
MAX_SITEMAP_ENTRIES = 4000
MAX_INDEX_DEPTH = 2
RETRIES = 2
CRAWL_DELAY = 1.0
USER_AGENT = (
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 "
    "(KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
)
