"""Continuous ingest of document snapshots with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from presscan.operators.resolve import classify, to_articles, utc_stamp
from presscan.schema import ARTICLE_FIELDS, ARTICLE_SCHEMA, DOCUMENT_SCHEMA, USER_AGENT
from presscan.sinks import REMOVED, UpsertTable, folders
from presscan.sources.documents import article_pages
from presscan.sources.pages import METADATA_COLUMNS, page_metadata
from presscan.streaming.crawl import Crawl

_METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("url", *METADATA_COLUMNS)])
ARTICLE_KEY = ("url", "keyword")
_ENTRY = ("keyword", "url", "site_key", "title", "published_at", "image_url")
#: Folders that a seen URL can be in; a batch looks into those of its own URLs only.
SEEN_BUCKETS = 64


def stream_documents(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.format(fmt).schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def _run(
    documents: DataFrame, step: Callable[[DataFrame, tuple[str, int]], None], checkpoint: str, trigger: dict | None
) -> StreamingQuery:
    def named(batch: DataFrame, batch_id: int) -> None:
        # The query id lives in the checkpoint: another checkpoint's batches are other writes.
        origin = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        step(batch, (origin, batch_id))

    return (
        documents.writeStream.foreachBatch(named)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_entries(
    documents: DataFrame,
    sites: DataFrame,
    keywords: str | Sequence[str] | DataFrame,
    path: str,
    checkpoint: str,
    include_archive: bool = False,
    wait_for_robots: bool = True,
    user_agent: str = USER_AGENT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append matching entries to ``path/entries``, each keyword and URL once for good.

    An entry is passed on when a sitemap that its site's roots lead to names it and robots
    rules allow both; as it cannot be taken back, it waits for the robots files it
    depends on. However late a row comes, it counts: what was passed on before is looked up
    in the output itself, which is kept in folders by hash of the URL.
    """
    spark = documents.sparkSession
    crawl = Crawl(spark, path, sites, keywords, include_archive, wait_for_robots, user_agent)

    def step(batch: DataFrame, write: tuple[str, int]) -> None:
        bucket = F.pmod(F.xxhash64("url"), F.lit(SEEN_BUCKETS)).cast("int")
        standing = crawl.take(batch, write).standing.select(*_ENTRY, bucket.alias("bucket"))
        mine = [r["bucket"] for r in standing.select("bucket").distinct().collect()]  # SEEN_BUCKETS at most
        earlier = [f"{path}/entries/batch={n}" for n in folders(spark, f"{path}/entries") if n < write[1]]
        if earlier:
            seen = _entries(spark, path, earlier).where(F.col("bucket").isin(mine))
            standing = standing.join(seen.select("keyword", "url"), ["keyword", "url"], "left_anti")
        out = f"{path}/entries/batch={write[1]}"
        standing.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)

    return _run(documents, step, checkpoint, trigger)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries that a stream has passed on to ``path``."""
    written = [f"{path}/entries/batch={n}" for n in folders(spark, f"{path}/entries")]
    return _entries(spark, path, written).select(*_ENTRY)


def _entries(spark: SparkSession, path: str, written: list[str]) -> DataFrame:
    schema = ", ".join(f"{name} string" for name in _ENTRY) + ", bucket int"
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/entries").parquet(*written)


def stream_articles(
    documents: DataFrame,
    sites: DataFrame,
    keywords: str | Sequence[str] | DataFrame,
    path: str,
    checkpoint: str,
    scraped_at: datetime | str | None = None,
    include_archive: bool = False,
    wait_for_robots: bool = False,
    user_agent: str = USER_AGENT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the articles table at ``path/articles`` up to date, one row per URL and keyword.

    Documents may arrive in any order and in different batches. After a batch the table
    holds what a search without caps over all documents so far would find; an article whose
    page no longer qualifies, or that a late robots file forbids, is taken out again.
    """
    spark = documents.sparkSession
    crawl = Crawl(spark, path, sites, keywords, include_archive, wait_for_robots, user_agent)
    known_pages = UpsertTable(spark, f"{path}/pages", schema=_METADATA)
    articles = articles_table(spark, path)

    def step(batch: DataFrame, write: tuple[str, int]) -> None:
        # Pages are read where they are scanned; only their metadata is compared.
        tried = article_pages(batch).where(F.col("body").isNotNull()).select("url", "fetched_at", "attempt", "body")
        latest = page_metadata(tried, "body").withColumn("_at", F.struct("fetched_at", "attempt"))
        known_pages.upsert(latest.select(*_METADATA.names, "_at"), "_at", write)
        outcome = crawl.take(batch, write, tried)
        metadata = known_pages.read().join(outcome.standing.select("url"), "url", "left_semi")
        stamp = scraped_at if isinstance(scraped_at, str) else utc_stamp(scraped_at or datetime.now(timezone.utc))
        judged = classify(outcome.standing, metadata)
        rows = to_articles(judged, stamp, F.col("dropped").isNotNull().alias(REMOVED))
        gone = outcome.touched.join(outcome.standing, list(ARTICLE_KEY), "left_anti")
        empty = [F.col(c) if c in ARTICLE_KEY else F.lit(None).cast("string").alias(c) for c in ARTICLE_FIELDS]
        rows = rows.unionByName(gone.select(*empty, F.lit(True).alias(REMOVED)))
        articles.upsert(rows.withColumn("_one", F.lit(0)), "_one", write)

    return _run(documents, step, checkpoint, trigger)


def articles_table(spark: SparkSession, path: str) -> UpsertTable:
    """The table that :func:`stream_articles` keeps under ``path``."""
    return UpsertTable(spark, f"{path}/articles", ARTICLE_KEY, ARTICLE_SCHEMA)
