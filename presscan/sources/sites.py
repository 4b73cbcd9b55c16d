"""The registry of outlets, a dimension table.

A further outlet is a further row; no code is needed for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_SCHEMA = (
    "site_ord int, site_key string, name string, base_url string, host_token string, "
    "article_match_on string, article_regex string, slug_strip_regex string, "
    "news_sitemaps array<string>, archive_sitemaps array<string>"
)

# The two registered outlets and the shapes of their URLs.
ARTICLE_CODE = r"-[A-Z]{1,4}\d{3,}[A-Z0-9]*$"
DATED_PERMALINK = r"^/\d{4}/\d{2}/\d{2}/[^/]+/?$"
_REGISTERED = (
    (
        0,
        "elheraldo",
        "El Heraldo",
        "https://www.elheraldo.hn",
        "elheraldo.hn",
        "last_segment",
        ARTICLE_CODE,
        ARTICLE_CODE,
        ["https://www.elheraldo.hn/sitemapforgoogle.xml"],
        ["https://www.elheraldo.hn/megasitemap.xml"],
    ),
    (
        1,
        "latribuna",
        "La Tribuna",
        "https://www.latribuna.hn",
        "latribuna.hn",
        "path",
        DATED_PERMALINK,
        None,
        ["https://www.latribuna.hn/news-sitemap.xml"],
        ["https://www.latribuna.hn/sitemap_index.xml"],
    ),
)


def available_sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_REGISTERED), SITE_SCHEMA)


def select_sites(
    spark: SparkSession, keys: Sequence[str] | None = None, sites: DataFrame | None = None
) -> DataFrame:
    """The requested sites, in request order, repeats kept; no keys mean all.

    ``keys`` is a short list typed by a user, so the check for unknown ones
    collects at most that many rows; only an error lists all keys there are.
    """
    sites = available_sites(spark) if sites is None else sites
    if not keys:
        return sites
    rows = [(i, k, k.strip().lower()) for i, k in enumerate(keys)]
    wanted = spark.createDataFrame(rows, "site_ord int, _raw string, site_key string")
    unknown = [r["_raw"] for r in wanted.join(sites, "site_key", "left_anti").orderBy("site_ord").collect()]
    if unknown:
        known = [r["site_key"] for r in sites.orderBy("site_ord").select("site_key").collect()]
        raise KeyError(f"no site has the key {', '.join(unknown)}; keys are {', '.join(known)}")
    return wanted.drop("_raw").join(sites.drop("site_ord"), "site_key").select(*sites.columns)


def sitemap_roots(sites: DataFrame, include_archive: bool = False) -> DataFrame:
    """``(site_ord, url, path)``: news sitemaps, then archive ones, in order."""
    urls = F.col("news_sitemaps")
    if include_archive:
        urls = F.concat(urls, F.col("archive_sitemaps"))
    return sites.select("site_ord", F.posexplode(urls).alias("_pos", "url")).select(
        "site_ord", "url", F.array("_pos").alias("path")
    )
