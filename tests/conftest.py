from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

from presscan import DOCUMENT_SCHEMA, build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = build_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of a column expression over rows of one string column ``v``."""

    def run(expression, values: list) -> list:
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r["o"] for r in rows.select("i", expression.alias("o")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def web(spark):
    """Documents from ``(url, kind, body)`` or ``(url, kind, body, attempt, status)``."""

    def make(*rows: tuple) -> DataFrame:
        full = [(r[0], r[1], *((r[3], r[4]) if len(r) > 3 else (1, 200)), r[2], None) for r in rows]
        return spark.createDataFrame(full, DOCUMENT_SCHEMA)

    return make


SITE = "site_ord int, site_key string, name string, base_url string, host_token string, article_match_on string, article_regex string, slug_strip_regex string, news_sitemaps array<string>, archive_sitemaps array<string>"


@pytest.fixture(scope="session")
def outlets(spark):
    """Sites ``key -> (news sitemaps, archive sitemaps)`` on hosts ``<key>.test``."""

    def make(**sitemaps) -> DataFrame:
        rows = [
            (i, key, key.upper(), f"https://{key}.test", f"{key}.test", "path", r"^/\d{4}/[^/]+/?$", None, news, archive)
            for i, (key, (news, archive)) in enumerate(sitemaps.items())
        ]
        return spark.createDataFrame(rows, SITE)

    return make


def urlset(*entries: str) -> str:
    return (
        '<?xml version="1.0"?><urlset xmlns="s" xmlns:news="n" xmlns:image="i">'
        + "".join(f"<url>{e}</url>" for e in entries)
        + "</urlset>"
    )


def titled(url: str, title: str) -> str:
    return f"<loc>{url}</loc><news:news><news:title>{title}</news:title></news:news>"


def index(*urls: str) -> str:
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
