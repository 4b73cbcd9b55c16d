"""Candidates and page metadata to articles, and reports over them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.functions.dates import to_iso8601
from presscan.functions.reuse import built_once
from presscan.functions.text import keyword_matches
from presscan.schema import ARTICLE_FIELDS
from presscan.sources.pages import METADATA_COLUMNS


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def utc_stamp(at: datetime) -> str:
    """UTC, to the second."""
    return at.astimezone(timezone.utc).isoformat(timespec="seconds")


def classify(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Candidates merged with their page, and why a row would be dropped.

    ``metadata`` has one row per ``url``; a candidate without one lives on its
    sitemap data. ``dropped`` is ``no_title``, ``keyword`` or NULL.
    """
    page = metadata.select("url", *[F.col(c).alias(f"_page_{c}") for c in METADATA_COLUMNS])
    merged = candidates.join(page, "url", "left").withColumns(
        {
            "title": F.coalesce(_filled(F.col("_page_title")), _filled(F.col("title"))),
            "description": F.col("_page_description"),
            "author": F.col("_page_author"),
            "published_at": F.coalesce(
                _filled(F.col("_page_published_at")), to_iso8601("published_at")
            ),
            "image_url": F.coalesce(_filled(F.col("_page_image_url")), _filled(F.col("image_url"))),
        }
    )
    merged = merged.drop(*[f"_page_{c}" for c in METADATA_COLUMNS])
    return merged.withColumn("dropped", _reason_to_drop())


@built_once
def _reason_to_drop() -> Column:
    matches = keyword_matches(F.col("keyword"), "title", "description")
    return F.when(F.col("title").isNull(), F.lit("no_title")).when(~matches, F.lit("keyword"))


def resolve_articles(
    candidates: DataFrame, metadata: DataFrame, scraped_at: datetime | str
) -> DataFrame:
    """Articles in canonical column order; the clock is passed in."""
    stamp = scraped_at if isinstance(scraped_at, str) else utc_stamp(scraped_at)
    kept = classify(candidates, metadata).where(F.col("dropped").isNull())
    return to_articles(kept, stamp)


def to_articles(resolved: DataFrame, stamp: str, *extra: Column) -> DataFrame:
    stamped = resolved.withColumns({"source": F.col("site_key"), "scraped_at": F.lit(stamp)})
    return stamped.select(*ARTICLE_FIELDS, *extra)


def search_funnel(scanned: DataFrame, candidates: DataFrame, classified: DataFrame) -> DataFrame:
    """Per site: entries scanned, candidates matched, rows kept and dropped.

    ``scanned`` has ``site_key`` and a number of entries ``n`` per document.

    The stages are tagged and counted in one aggregation; all of it combines
    map-side into one row per site and task.
    """

    def tagged(df: DataFrame, stage: Column, n: Column | None = None) -> DataFrame:
        n = F.lit(1) if n is None else n
        return df.select("site_key", stage.alias("stage"), n.cast("bigint").alias("n"))

    events = (
        tagged(scanned, F.lit("scanned"), F.col("n"))
        .unionByName(tagged(candidates, F.lit("matched")))
        .unionByName(tagged(classified, F.coalesce("dropped", F.lit("resolved"))))
    )
    stages = ("scanned", "matched", "robots", "no_title", "keyword", "resolved")
    return events.groupBy("site_key").agg(
        *[F.sum(F.when(F.col("stage") == s, F.col("n")).otherwise(0)).alias(s) for s in stages]
    )


def article_report(articles: DataFrame) -> DataFrame:
    """The listing: source, date, title, author, url."""
    return articles.select(
        "source",
        F.coalesce(_filled(F.col("published_at")), F.lit("(no date)")).alias("published_at"),
        "title",
        F.coalesce(_filled(F.col("author")), F.lit("(no author)")).alias("author"),
        "url",
    )
