"""State of a document stream: what has arrived, and what follows from it by now.

Robots files, indexes, url-sets and pages arrive in any order. Each is boiled down to a
narrow table of its own when it arrives, and a batch recomputes only what its
documents can change. So the outcome after a batch is that of all documents so far,
whatever came first: a robots file or an index that arrives late still decides.

========== ============================== =============================================
table      key                            content
========== ============================== =============================================
robots     origin                         the answer that counts, and its rule groups
catalog    url                            facts of a sitemap: index or not, its children
sitemaps   (one folder a batch)           url-sets as they came, for those reached late
leaves     (one folder a batch)           the url-sets that can be read, and on which path
candidates keyword, url, site, sitemap    matching entries of url-sets once reached
========== ============================== =============================================

A batch is named by the query and its number, and everything it writes is named by the batch,
so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presscan.functions.urls import url_origin
from presscan.operators.matching import match_entries
from presscan.operators.robots import ANSWER_ORDER, robots_answers, robots_verdict
from presscan.schema import DOCUMENT_SCHEMA, KIND_SITEMAP, MAX_INDEX_DEPTH, USER_AGENT
from presscan.session import stored
from presscan.sinks import UpsertTable, folders
from presscan.sources.documents import first_per_key
from presscan.sources.sitemaps import expand_sitemaps, leaf_entries, of_origins, sitemap_catalog
from presscan.sources.sites import sitemap_roots

_RULES = "array<struct<agents:array<string>,is_default:boolean,rules:array<struct<path:string,allow:boolean>>,delay:double>>"


# Columns of the tables and their types.
ROBOTS = {"origin": "string", "attempt": "int", "no_file": "boolean", "fetched_at": "timestamp", "groups": _RULES}
CATALOG = {"url": "string", "fetched_at": "timestamp", "is_index": "boolean", "children": "array<string>", "n_entries": "bigint"}
LEAVES = {"site_ord": "int", "path": "array<int>", "url": "string", "n_entries": "bigint"}
CANDIDATES = {
    "keyword": "string", "url": "string", "site_ord": "int", "source_sitemap": "string", "entry_ord": "int",
    "site_key": "string", "title": "string", "published_at": "string", "image_url": "string",
}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


CANDIDATE_KEY = ("keyword", "url", "site_ord", "source_sitemap")
_ANSWER = ("keyword", "url")


@dataclass(frozen=True)
class Outcome:
    """What a batch may have changed, and the candidates that stand now.

    ``touched`` has the keywords and URLs to look at again; ``standing`` those of them that an
    entry of a readable url-set names and robots rules allow, with the entry that counts.
    """

    touched: DataFrame
    standing: DataFrame


@dataclass(frozen=True)
class Crawl:
    """A stream's state under ``path``.

    ``wait_for_robots`` holds back what belongs to an origin until its robots file was asked
    for, whatever the answer; otherwise an origin without one is open until one arrives.
    """

    spark: SparkSession
    path: str
    sites: DataFrame
    keywords: str | Sequence[str] | DataFrame
    include_archive: bool = False
    wait_for_robots: bool = False
    user_agent: str = USER_AGENT
    robots: UpsertTable = field(init=False)
    catalog: UpsertTable = field(init=False)
    candidates: UpsertTable = field(init=False)

    def __post_init__(self) -> None:
        for name, key, schema in (("robots", "origin", ROBOTS), ("catalog", "url", CATALOG), ("candidates", CANDIDATE_KEY, CANDIDATES)):
            object.__setattr__(self, name, UpsertTable(self.spark, f"{self.path}/{name}", key, _ddl(schema)))

    def take(self, batch: DataFrame, write: tuple[str, int], pages: DataFrame | None = None) -> Outcome:
        """Add a batch's robots files and sitemaps; ``pages`` (column ``url``) names pages that came with it."""
        batch_id = write[1]
        asked = robots_answers(batch)
        _keep_smaller(self.robots, asked.select(*ROBOTS), ANSWER_ORDER, write)
        _keep_smaller(self.catalog, sitemap_catalog(batch).select(*CATALOG), ("fetched_at",), write)
        arrived = batch.where(F.col("kind") == KIND_SITEMAP)
        arrived.select(*DOCUMENT_SCHEMA.names).write.mode("overwrite").parquet(f"{self.path}/sitemaps/batch={batch_id}")

        before = self._leaves(batch_id)
        known = stored(self.robots.read())
        policies = known.where("groups IS NOT NULL").select("origin", "groups")
        origins = known.select("origin") if self.wait_for_robots else None
        roots = sitemap_roots(self.sites, self.include_archive)
        catalog = self.catalog.read()  # a written table already
        now = expand_sitemaps(roots, lambda _: catalog, policies, MAX_INDEX_DEPTH, self.user_agent, origins)
        now.select(*LEAVES).write.mode("overwrite").parquet(f"{self.path}/leaves/batch={batch_id}")
        now = self.spark.read.schema(_ddl(LEAVES)).parquet(f"{self.path}/leaves/batch={batch_id}")

        place = ["site_ord", "url", "path"]
        changed = now.join(before, place, "left_anti").select(*place).unionByName(before.join(now, place, "left_anti").select(*place))
        changed = stored(changed.select("site_ord", F.col("url").alias("source_sitemap")).distinct())
        self._read_new(now, before, arrived, write)

        candidates = self.candidates.read()
        origin = candidates.withColumn("_origin", url_origin("url"))
        touched = [
            candidates.join(changed, ["site_ord", "source_sitemap"], "left_semi").select(*_ANSWER),
            origin.join(asked.select(F.col("origin").alias("_origin")), "_origin", "left_semi").select(*_ANSWER),
        ]
        if pages is not None:
            touched.append(candidates.join(pages.select("url"), "url", "left_semi").select(*_ANSWER))
        first, *rest = touched
        for part in rest:
            first = first.unionByName(part)
        touched = stored(first.distinct())

        leaves = now.select("site_ord", F.col("url").alias("source_sitemap"), "path")
        named = candidates.join(touched, list(_ANSWER), "left_semi").join(leaves, ["site_ord", "source_sitemap"])
        best = first_per_key(named, list(_ANSWER), [F.col(c) for c in ("site_ord", "path", "entry_ord")])
        standing = robots_verdict(best, policies, self.user_agent).where("allowed").drop("allowed", "delay")
        if origins is not None:
            standing = of_origins(standing, origins)
        return Outcome(touched, stored(standing))

    def _leaves(self, before: int) -> DataFrame:
        """The leaves after the last batch ahead of ``before``."""
        earlier = [n for n in folders(self.spark, f"{self.path}/leaves") if n < before]
        if not earlier:
            return self.spark.createDataFrame([], _ddl(LEAVES))
        return self.spark.read.schema(_ddl(LEAVES)).parquet(f"{self.path}/leaves/batch={max(earlier)}")

    def _read_new(self, now: DataFrame, before: DataFrame, arrived: DataFrame, write: tuple[str, int]) -> None:
        """Candidates of the url-sets that could not be read before.

        They are in this batch as a rule; older documents are only read for url-sets
        that an index, or a robots file, has opened since they came.
        """
        key = ["site_ord", "url"]
        new = now.join(before.select(*key), key, "left_anti")
        fresh = stored(new.join(arrived.select("url", F.lit(True).alias("_here")).distinct(), "url", "left"))
        documents = arrived
        if not fresh.where("_here IS NULL").isEmpty():
            documents = self.spark.read.schema(DOCUMENT_SCHEMA).parquet(f"{self.path}/sitemaps/batch=*")
        # A url-set on several paths of a site is read once.
        leaves = fresh.select(*key, F.array().cast("array<int>").alias("path")).distinct()
        found = match_entries(leaf_entries(leaves, documents), self.sites, self.keywords)
        self.candidates.upsert(found.select(*CANDIDATES).withColumn("_last", -F.col("entry_ord")), "_last", write)


def _keep_smaller(table: UpsertTable, rows: DataFrame, order: Sequence[str], write: tuple[str, int]) -> None:
    """Upsert those rows that come before what the table has of their key."""
    known = table.read().select(*table.key, F.struct(*order).alias("_known"))
    better = rows.join(known, table.key, "left").where(F.col("_known").isNull() | (F.struct(*order) < F.col("_known")))
    table.upsert(better.select(*rows.columns).withColumn("_one", F.lit(0)), "_one", write)
