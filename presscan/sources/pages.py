"""Article metadata from HTML snapshots, row-local from scan to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.functions import jsonld, markup
from presscan.functions.dates import to_iso8601
from presscan.functions.reuse import built_once
from presscan.functions.text import first_nonblank, trim_space
from presscan.schema import RETRIES
from presscan.sources.documents import first_per_key

METADATA_COLUMNS = ("title", "description", "author", "published_at", "image_url")


def is_real_author(value: Column | str) -> Column:
    """Reject blank values, paths and links put where a name belongs."""
    name = trim_space(value)
    pathlike = F.contains(name, F.lit("/")) & ~F.contains(name, F.lit(" "))
    return F.coalesce(
        (name != "") & ~F.startswith(name, F.lit("/")) & ~F.startswith(name, F.lit("http")) & ~pathlike,
        F.lit(False),
    )


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, plus the five metadata columns."""
    tokens = pages.withColumn("_tokens", markup.page_tokens(html)).drop(html)
    raw = tokens.withColumn("_page", markup.gathered("_tokens")).drop("_tokens")
    return resolve_metadata(raw, "_page")


def first_page_metadata(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """Metadata of the first attempt at every ``url`` that has a ``body``, of ``retries + 1``.

    Attempts with a body are read where they are scanned; only what was found in them is
    compared, so no page is sorted or sent anywhere. A URL has one such attempt as a rule.
    """
    tried = attempts.where((F.col("attempt") <= retries + 1) & F.col("body").isNotNull())
    read = page_metadata(tried.select("url", "attempt", "body"), "body")
    return first_per_key(read, ["url"], [F.col("attempt")]).drop("attempt")


def resolve_metadata(gathered: DataFrame, page: str = "gathered") -> DataFrame:
    """The five columns from a gathered page, which is dropped.

    JSON-LD comes first for everything but the image; a first date that does
    not parse gives NULL, and so does a first meta author that is no name.
    """
    keep = [F.col(c) for c in gathered.columns if c != page]
    staged = gathered.select(
        *keep,
        F.col(f"{page}.meta").alias("_meta"),
        F.col(f"{page}.doc_title").alias("_doc_title"),
        jsonld.pick_article_node(f"{page}.ldjson").alias("_node"),
    )
    staged = staged.select(*keep, *_candidates_for_columns("_node", "_meta", "_doc_title"))
    return staged.select(
        *keep,
        "title",
        "description",
        _author("_ld_author", "_meta_author").alias("author"),
        to_iso8601("_date").alias("published_at"),
        "image_url",
    )


@built_once
def _candidates_for_columns(node: str, tags: str, doc_title: str) -> list[Column]:
    """First non-blank value per column, in the order of priority."""

    def ld(name: str) -> Column:
        return jsonld.jsonld_string(node, name)

    def meta(*names: str) -> list[Column]:
        return [markup.meta_content(tags, n) for n in names]

    return [
        first_nonblank(ld("headline"), ld("name"), *meta("og:title", "twitter:title"), F.col(doc_title)).alias("title"),
        first_nonblank(
            ld("description"), *meta("og:description", "description", "twitter:description")
        ).alias("description"),
        jsonld.jsonld_name(jsonld.jsonld_field(node, "author")).alias("_ld_author"),
        first_nonblank(*meta("author", "article:author", "byl")).alias("_meta_author"),
        first_nonblank(
            ld("datePublished"), *meta("article:published_time", "datePublished", "date"), ld("dateCreated")
        ).alias("_date"),
        first_nonblank(
            *meta("og:image"),
            jsonld.jsonld_url(jsonld.jsonld_field(node, "image")),
            jsonld.jsonld_url(jsonld.jsonld_field(node, "thumbnailUrl")),
            *meta("twitter:image"),
        ).alias("image_url"),
    ]


@built_once
def _author(ld_author: str, meta_author: str) -> Column:
    return F.when(is_real_author(ld_author), F.col(ld_author)).when(is_real_author(meta_author), F.col(meta_author))
