"""The whole search as one composition of operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presscan.functions.text import nonblank
from presscan.functions.urls import url_origin
from presscan.operators.matching import match_entries
from presscan.operators.ranking import interleave, limit_leaves
from presscan.operators.resolve import classify, search_funnel, to_articles, utc_stamp
from presscan.operators.robots import robots_policies, robots_verdict
from presscan.schema import (
    CRAWL_DELAY,
    MAX_ARTICLES,
    MAX_INDEX_DEPTH,
    MAX_SITEMAP_ENTRIES,
    RETRIES,
    USER_AGENT,
)
from presscan.session import stored
from presscan.sources.documents import article_pages, first_per_key
from presscan.sources.pages import first_page_metadata
from presscan.sources.sitemaps import expand_sitemaps, leaf_entries, sitemap_catalog
from presscan.sources.sites import sitemap_roots


@dataclass(frozen=True)
class SearchOptions:
    """Options that change results; counts are at least 1, the others at least 0."""

    max_articles: int = MAX_ARTICLES
    max_sitemap_entries: int = MAX_SITEMAP_ENTRIES
    include_archive: bool = False
    retries: int = RETRIES
    delay: float = CRAWL_DELAY
    user_agent: str = USER_AGENT

    def __post_init__(self) -> None:
        for name in ("max_articles", "max_sitemap_entries"):
            object.__setattr__(self, name, max(1, getattr(self, name)))
        for name in ("retries", "delay"):
            object.__setattr__(self, name, max(0, getattr(self, name)))


@dataclass(frozen=True)
class Corpus:
    """Fetched documents, and what is known about their sitemaps and robots files.

    Without a catalog a search reads only the sitemaps that its sites lead to, and the robots files
    of the origins it meets; :meth:`of` reads them all once, for many searches over many sites.
    """

    documents: DataFrame
    catalog: DataFrame | None = None
    policies: DataFrame | None = None

    @classmethod
    def of(cls, documents: DataFrame | Corpus) -> Corpus:
        """Read robots files and sitemap structure once; keep it for more searches."""
        if isinstance(documents, Corpus) and documents.catalog is not None:
            return documents
        documents = documents.documents if isinstance(documents, Corpus) else documents
        return cls(documents, stored(sitemap_catalog(documents)), stored(robots_policies(documents)))

    @classmethod
    def over(cls, documents: DataFrame | Corpus) -> Corpus:
        return documents if isinstance(documents, Corpus) else cls(documents)

    def facts(self, urls: DataFrame) -> DataFrame:
        """The catalog's rows of the sitemaps ``urls``."""
        if self.catalog is not None:
            return self.catalog
        return sitemap_catalog(self.documents.join(urls.select("url").distinct(), "url", "left_semi"))

    def rules(self, urls: DataFrame) -> DataFrame:
        """The robots policies of the origins of ``urls``."""
        if self.policies is not None:
            return self.policies
        files = urls.select(F.concat(url_origin("url"), F.lit("/robots.txt")).alias("url")).distinct()
        return robots_policies(self.documents.join(files, "url", "left_semi"))


def scan_plan(corpus: Corpus, sites: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Url-sets to read, and how many entries of each fit the site's budget."""
    leaves = expand_sitemaps(
        sitemap_roots(sites, options.include_archive),
        corpus.facts,
        corpus.rules,
        MAX_INDEX_DEPTH,
        options.user_agent,
    )
    return stored(limit_leaves(leaves, options.max_sitemap_entries))


def scan_entries(
    documents: DataFrame | Corpus, sites: DataFrame, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """The entries within every site's budget, in a form that carries order."""
    corpus = Corpus.over(documents)
    return leaf_entries(scan_plan(corpus, sites, options), corpus.documents, take="take")


def _first_matches(entries: DataFrame, sites: DataFrame, keywords: str | Sequence[str] | DataFrame) -> DataFrame:
    matched = match_entries(entries, sites, keywords)
    return first_per_key(matched, ["keyword", "url"], [F.col(c) for c in ("site_ord", "path", "entry_ord")])


def discover(
    documents: DataFrame | Corpus,
    sites: DataFrame,
    keywords: str | Sequence[str] | DataFrame,
    options: SearchOptions = SearchOptions(),
) -> DataFrame:
    """Matching entries, one per keyword and URL: the first in scan order.

    Entries that do not match never take a URL away from a later one.
    """
    return _first_matches(scan_entries(documents, sites, options), sites, keywords)


def shortlist(candidates: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The fair, capped list of every keyword."""
    return interleave(candidates, limit=options.max_articles, per=("keyword",))


def candidate_metadata(documents: DataFrame, candidates: DataFrame, options: SearchOptions) -> DataFrame:
    """Metadata of the candidates' pages, one row per URL.

    Raw pages are narrowed to the candidates before anything is parsed, and
    read before anything is shuffled. The candidates are a written table, so Spark knows their
    size and lets the page scan feed straight into the semi join while they are few.
    """
    pages = article_pages(documents).select("url", "attempt", "body").join(candidates.select("url"), "url", "left_semi")
    return first_page_metadata(pages, options.retries)


def _verdicts(corpus: Corpus, chosen: DataFrame, options: SearchOptions) -> DataFrame:
    """The shortlist with its robots verdicts, stored: the page scan and the final join use it."""
    return stored(robots_verdict(chosen, corpus.rules(chosen), options.user_agent, options.delay))


def _resolved(corpus: Corpus, verdicts: DataFrame, options: SearchOptions) -> DataFrame:
    """Refused pages are never read."""
    allowed = verdicts.where("allowed").drop("allowed", "delay")
    return classify(allowed, candidate_metadata(corpus.documents, allowed, options))


def search_many(
    documents: DataFrame | Corpus,
    sites: DataFrame,
    keywords: Sequence[str] | DataFrame,
    scraped_at: datetime | str | None = None,
    options: SearchOptions = SearchOptions(),
    position: bool = False,
) -> DataFrame:
    """Articles for several keywords at once, each with its own cap.

    ``keywords`` is a list, or a table of any size with a column ``keyword``. With ``position``
    a column of that name orders the articles: keywords as listed (those of a table by
    their text), and the turns of each.
    """
    if isinstance(keywords, DataFrame):
        words = keywords.select("keyword")
        blank = not words.where(nonblank("keyword").isNull()).isEmpty()
    else:
        words = list(dict.fromkeys(keywords))
        blank = not words or any(not w.strip() for w in words)
    if blank:
        raise ValueError("a keyword must not be empty")
    stamp = scraped_at if isinstance(scraped_at, str) else utc_stamp(scraped_at or datetime.now(timezone.utc))
    corpus = Corpus.over(documents)
    verdicts = _verdicts(corpus, stored(shortlist(discover(corpus, sites, words, options), options)), options)
    kept = _resolved(corpus, verdicts, options).where(F.col("dropped").isNull())
    if not position:
        return to_articles(kept, stamp)
    listed = F.lit(0) if isinstance(words, DataFrame) else F.array_position(F.lit(words), F.col("keyword"))
    return to_articles(kept, stamp, F.struct(listed.alias("listed"), "keyword", "turn", "site_ord", "path", "entry_ord").alias("position"))


def search(
    documents: DataFrame | Corpus,
    sites: DataFrame,
    keyword: str,
    scraped_at: datetime | str | None = None,
    options: SearchOptions = SearchOptions(),
    position: bool = False,
) -> DataFrame:
    """Articles of ``sites`` that mention ``keyword``."""
    return search_many(documents, sites, [keyword], scraped_at, options, position)


def funnel(
    documents: DataFrame | Corpus, sites: DataFrame, keyword: str, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """What every stage of :func:`search` kept and dropped, per site."""
    corpus = Corpus.over(documents)
    plan = scan_plan(corpus, sites, options)
    scanned = plan.join(sites.select("site_ord", "site_key"), "site_ord").select("site_key", F.col("take").alias("n"))
    entries = leaf_entries(plan, corpus.documents, take="take")
    candidates = stored(_first_matches(entries, sites, keyword))
    verdicts = _verdicts(corpus, stored(shortlist(candidates, options)), options)
    refused = verdicts.where(~F.col("allowed"))
    classified = _resolved(corpus, verdicts, options).select("site_key", "dropped")
    return search_funnel(
        scanned, candidates, classified.unionByName(refused.select("site_key", F.lit("robots").alias("dropped")))
    )
