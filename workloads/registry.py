"""The queries of ``__spark_entry__`` and the SQL that checks them.

A query reads the driver's tables, or web documents derived from them. The SQL
goes straight to the tables and never parses XML, JSON or robots files, so the
two share no logic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import presscan as ps
from presscan.functions.jsonld import jsonld_nodes, node_types
from presscan.functions.markup import gather_page, page_title
from presscan.functions.urls import url_netloc
from presscan.operators.ranking import limit_leaves
from presscan.operators.robots import agent_policy
from presscan.session import shared_folder
from presscan.sources.sitemaps import leaf_entries, sitemap_catalog
from workloads.derived import (
    article_pages_table,
    documents_table,
    robots_documents,
    sites_table,
    table,
    titled_pages,
    url_sets,
    written,
)

STAMP = "2026-06-16T00:00:00+00:00"
KEYWORD = "1"
KEYWORDS = ["1", "STÓRY 2", "thé"]
BUDGET = 3
#: Files that documents arrive in.
ARRIVALS = 6

# --- text, dates, URLs ---------------------------------------------------


def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ps.normalize_text("text").alias("norm"))


def strip_accents(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ps.strip_accents("text").alias("plain"))


def keyword_search(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(ps.keyword_matches("ÉAU  que", "text")).select("doc_id", "source", "lang")


def keyword_column(spark, sf):
    """The keyword differs from row to row, and two texts are searched."""
    docs = table(spark, sf, "documents")
    keyword = F.concat(F.upper("lang"), F.lit(" "), F.substring("source", 1, 4))
    return docs.select("doc_id", ps.keyword_matches(keyword, "text", "source").alias("hit"))


def iso_dates(spark, sf):
    orders = table(spark, sf, "orders")
    day, shape = F.col("o_orderdate"), F.col("o_orderkey") % 12
    text = (
        F.when(shape == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 1, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(shape == 2, F.date_format(day, "MMMM d, yyyy h:mm a"))
        .when(shape == 3, F.date_format(day, "MM/dd/yyyy"))
        .when(shape == 4, F.date_format(day, "yyyyMMdd"))
        .when(shape == 5, F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-0600\n")))
        .when(shape == 6, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 6pm")))
        .when(shape == 7, F.date_format(day, "dd-MMM-yy"))
        .when(shape == 8, F.date_format(day, "yyyy MMMM d"))
        .when(shape == 9, F.date_format(day, "EEE, d MMM yyyy HH:mm:ss '-0600 (CST)'"))
        .when(shape == 10, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'.1234567890Z'"))
        .otherwise(F.date_format(day, "EEE MMM dd '18:14:00 EST' yyyy"))
    )
    return orders.select("o_orderkey", ps.to_iso8601(text).alias("iso"))


def iso_timestamps(spark, sf):
    events = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'Z'")).when(
        F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+05:30")
    )
    return events.select("event_id", ps.to_iso8601(F.coalesce(text, "props")).alias("iso"))


def url_parts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        ps.url_origin("url").alias("origin"),
        F.size(ps.path_segments("url")).cast("bigint").alias("n_segments"),
        ps.last_segment("url").alias("last"),
    )


def slug_text(spark, sf):
    """Slugs made of part names and brands, with a trailing article code."""
    part = table(spark, sf, "part")
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.lower("p_brand"))
    url = F.concat(
        F.lit("https://shop.example/p/"), F.replace(slug, F.lit("#"), F.lit("%23")), F.lit("-AB"),
        F.col("p_partkey") + 100, F.lit("/?x=1"),
    )
    return part.select("p_partkey", ps.slug_text(url, F.lit(r"-[A-Z]{1,4}\d{3,}[A-Z0-9]*$")).alias("words"))


def article_url(spark, sf):
    """Which outlet of a dimension of four, if any, calls a page an article."""
    rules = [
        ("a", ".com", "path", r"^/[a-z]{2}/\d+/?$"),
        ("b", ".net", "last_segment", r"^\d{3}$"),
        ("c", "blog", "last_segment", r"\.html$"),
        ("d", ".example.", "path", r"^/es/"),
    ]
    pages = table(spark, sf, "pages")
    hits = F.array_compact(
        F.array(
            *[
                F.when(ps.is_article_url("url", F.lit(token), F.lit(on), F.lit(rx)), F.lit(key))
                for key, token, on, rx in rules
            ]
        )
    )
    return pages.select("page_id", F.array_join(hits, ",").alias("outlets"))


# --- pages ---------------------------------------------------------------


def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", page_title("html").alias("title"))


def gathered_pages(spark, sf):
    page = article_pages_table(spark, sf).select("doc_id", gather_page("html").alias("g"))
    return page.select(
        "doc_id",
        F.size("g.ldjson").cast("bigint").alias("n_ldjson"),
        F.array_join(F.transform("g.meta", lambda m: m["key"]), ",").alias("meta_keys"),
        F.col("g.doc_title").alias("doc_title"),
    )


def jsonld_flatten(spark, sf):
    """Nodes of every page's JSON-LD, in order, by their types."""
    page = article_pages_table(spark, sf).select("doc_id", gather_page("html")["ldjson"].alias("blocks"))
    nodes = page.select("doc_id", F.posexplode(jsonld_nodes("blocks")).alias("ord", "node"))
    return nodes.select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.array_join(node_types(F.col("node.v")), "+").alias("types"),
        F.try_variant_get(F.col("node.v"), "$.headline", "string").alias("headline"),
    )


def page_metadata(spark, sf):
    return ps.page_metadata(article_pages_table(spark, sf))


def real_authors(spark, sf):
    """Author checks on names, paths and links made from customers."""
    shape = F.col("c_custkey") % 5
    author = (
        F.when(shape == 0, F.col("c_name"))
        .when(shape == 1, F.concat(F.lit("/authors/"), F.col("c_name")))
        .when(shape == 2, F.concat(F.lit("https://x.example/"), F.col("c_name")))
        .when(shape == 3, F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_name")))
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" / "), F.col("c_name")))
    )
    return table(spark, sf, "customer").select("c_custkey", ps.is_real_author(author).alias("real"))


# --- sitemaps ------------------------------------------------------------


def sitemap_entries(spark, sf):
    docs = written(spark, sf, "url_sets", url_sets)
    return ps.sitemap_entries(docs).select("url", "title", "published_at", "image_url")


def sitemap_index(spark, sf):
    docs = documents_table(spark, sf).where("kind = 'sitemap'")
    children = ps.sitemap_children(docs)
    flags = docs.select("url", ps.is_sitemap_index("body").alias("is_index"))
    counted = children.groupBy(F.col("source_sitemap").alias("url")).agg(F.count("*").alias("n_children"))
    return flags.join(counted, "url", "left").select("url", "is_index", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def sitemap_expansion(spark, sf):
    roots = ps.sitemap_roots(sites_table(spark, sf), include_archive=True)
    leaves = ps.expand_sitemaps(roots, sitemap_catalog(documents_table(spark, sf)))
    return leaves.select(F.col("site_ord").cast("bigint").alias("site_ord"), F.array_join("path", "/").alias("path"), "url", "n_entries")


def sitemap_budget(spark, sf):
    docs = documents_table(spark, sf)
    roots = ps.sitemap_roots(sites_table(spark, sf), include_archive=True)
    leaves = limit_leaves(ps.expand_sitemaps(roots, sitemap_catalog(docs)), BUDGET)
    return leaf_entries(leaves, docs, take="take").select(
        F.col("site_ord").cast("bigint").alias("site_ord"), "url"
    )


def scan_limit(spark, sf):
    """The same cut made on rows instead of documents, on events by user."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return ps.limit_scan(events, 7, group="user_id", order=("ts", "event_id"))


# --- robots --------------------------------------------------------------


def robots_rules(spark, sf):
    rules = ps.robots_rules(written(spark, sf, "robots", robots_documents))
    return rules.select(
        "origin", F.col("group_ord").cast("bigint").alias("group_ord"), F.array_join("agents", "|").alias("agents"),
        "is_default", F.col("rule_ord").cast("bigint").alias("rule_ord"), "path", "allow",
    )


def robots_verdict(spark, sf):
    policies = ps.robots_policies(documents_table(spark, sf))
    return ps.robots_verdict(table(spark, sf, "pages").select("page_id", "url"), policies)


def robots_delays(spark, sf):
    policies = agent_policy(ps.robots_policies(documents_table(spark, sf)))
    return policies.select("origin", "advertised", F.size("rules").cast("bigint").alias("n_rules"))


# --- relational operators ------------------------------------------------


def site_urls(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", url_netloc("url").alias("site_key"))


def interleave_cap(spark, sf):
    return ps.interleave(site_urls(spark, sf), order=("page_id",), limit=40).select(
        "page_id", "site_key", F.col("turn").cast("bigint").alias("turn")
    )


def interleave_all(spark, sf):
    """No cap: every event takes its turn among the users'."""
    events = table(spark, sf, "events").select("event_id", "user_id")
    turns = ps.interleave(events, group="user_id", order=("event_id",))
    return turns.select("event_id", F.col("turn").cast("bigint").alias("turn"))


def keep_first(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "props")
    return ps.keep_first(events, "user_id", order=("ts", "event_id")).select("user_id", "event_id", "event_type", "props")


def first_success(spark, sf):
    events = table(spark, sf, "events")
    attempts = events.select(
        F.floor(F.col("event_id") / 5).alias("url"),
        (F.col("event_id") % 5 + 1).cast("int").alias("attempt"),
        F.when(~F.col("event_type").isin("error", "view"), F.col("props")).alias("body"),
    )
    return ps.first_success(attempts).select("url", F.col("attempt").cast("bigint").alias("attempt"), "body")


def usable_documents(spark, sf):
    docs = documents_table(spark, sf)
    usable = ps.usable_documents(docs).groupBy("kind").agg(F.count("body").alias("n_usable"))
    pages = ps.article_pages(docs).agg(F.count("body").alias("n_pages"))
    return usable.unionByName(pages.select(F.lit("any_status_page").alias("kind"), F.col("n_pages").alias("n_usable")))


def discover(spark, sf):
    found = ps.discover(documents_table(spark, sf), sites_table(spark, sf), KEYWORD)
    return found.select("site_key", "url", "title", "published_at", "image_url")


def resolve_articles(spark, sf):
    """Every page as a candidate, resolved against its own snapshot."""
    docs = documents_table(spark, sf)
    shape = F.col("page_id") % 4
    candidates = titled_pages(spark, sf).select(
        "url",
        F.col("host").alias("site_key"),
        F.when(shape != 1, F.col("headline")).alias("title"),
        F.when(shape == 3, F.lit("June 14, 2026 6:14 PM")).alias("published_at"),
        F.lit(None).cast("string").alias("image_url"),
        F.lit(KEYWORD).alias("keyword"),
    )
    metadata = ps.first_page_metadata(ps.article_pages(docs).select("url", "attempt", "body"))
    return ps.resolve_articles(candidates, metadata, STAMP)


def search(spark, sf):
    return ps.search(documents_table(spark, sf), sites_table(spark, sf), KEYWORD, STAMP)


def search_many(spark, sf):
    return ps.search_many(documents_table(spark, sf), sites_table(spark, sf), KEYWORDS, STAMP)


def keyword_table(spark, sf) -> DataFrame:
    """A keyword for every page: its number, which other pages' titles and slugs hold as well."""
    return table(spark, sf, "pages").select(F.concat(F.lit("STÓRY  "), F.col("page_id")).alias("keyword"))


def discover_table(spark, sf):
    found = ps.discover(documents_table(spark, sf), sites_table(spark, sf), keyword_table(spark, sf))
    return found.select("keyword", "site_key", "url", "title")


def search_table(spark, sf):
    return ps.search_many(documents_table(spark, sf), sites_table(spark, sf), keyword_table(spark, sf), STAMP)


def search_funnel(spark, sf):
    return ps.funnel(documents_table(spark, sf), sites_table(spark, sf), KEYWORD)


def article_report(spark, sf):
    return ps.article_report(resolve_articles(spark, sf))


# --- sinks and streams ---------------------------------------------------


def _articles(docs: DataFrame, version: str) -> DataFrame:
    return docs.select(
        F.lit("docs").alias("source"),
        F.concat(F.lit(f'{version} "quoted", '), F.col("lang")).alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("author"),
        F.lit(None).cast("string").alias("published_at"),
        F.lit("").alias("image_url"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id")).alias("url"),
        F.lit("k").alias("keyword"),
        F.lit(STAMP).alias("scraped_at"),
    )


def _two_batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents of even ids first; then all of them, in a second version."""
    docs = table(spark, sf, "documents")
    return _articles(docs.where(F.col("doc_id") % 2 == 0), "old"), _articles(docs, "new")


def _with_earlier(batch: DataFrame) -> DataFrame:
    """The batch with an earlier version of every row in it, in no order."""
    earlier = batch.withColumns({"title": F.lit("earlier"), "description": F.lit(None).cast("string"), "position": F.lit(1)})
    return earlier.unionByName(batch.withColumn("position", F.lit(2))).repartition(8, F.xxhash64("url", "position"))


def _new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def append_new(spark, sf):
    path = _new_path(spark, "csv")
    for batch in _two_batches(spark, sf):
        ps.append_new(batch, path)
    return ps.read_csv(spark, path).select("url", "title", "description", "author", "image_url")


def upsert(spark, sf):
    path = _new_path(spark, "table")
    for batch in _two_batches(spark, sf):
        ps.upsert(_with_earlier(batch), path, "position")
    return ps.UpsertTable(spark, path).read().select("url", "title", "description", "author")


def save_articles(spark, sf):
    """Articles of several keywords in both formats: of a URL that more than one of them finds, the table keeps the last."""
    out = _new_path(spark, "saved")
    found = ps.search_many(documents_table(spark, sf), sites_table(spark, sf), KEYWORDS, STAMP, position=True)
    for _ in range(2):  # saving again adds nothing
        ps.save_articles(found, out)
    csv = ps.read_csv(spark, f"{out}/articles.csv").groupBy("url").agg(F.count("*").alias("n_csv"))
    return ps.UpsertTable(spark, f"{out}/articles.table").read().join(csv, "url", "full").select("url", "title", "keyword", "n_csv")


def selected_sites(spark, sf):
    """Sites by keys in any case, in the order asked, repeats kept."""
    sites = sites_table(spark, sf)
    first, last = sites.agg(F.min("site_key"), F.max("site_key")).first()
    chosen = ps.select_sites(spark, [last, f" {first.upper()} ", last], sites)
    return chosen.select(F.col("site_ord").cast("bigint").alias("site_ord"), "site_key", "base_url")


def _arriving(spark, sf) -> str:
    """The documents as files that a stream reads a few at a time, in no order of kinds."""
    folder = _new_path(spark, "arriving")
    docs = documents_table(spark, sf)
    docs.repartition(ARRIVALS, F.xxhash64("url", "attempt")).write.parquet(folder)
    return folder


def stream_entries(spark, sf):
    """Arriving sitemaps and robots files, each matching URL once, for several keywords."""
    out, state = _new_path(spark, "seen"), _new_path(spark, "state")
    stream = ps.stream_documents(spark, _arriving(spark, sf), files_per_batch=2)
    ps.stream_entries(stream, sites_table(spark, sf), KEYWORDS, out, state).awaitTermination()
    return ps.read_entries(spark, out).select("keyword", "site_key", "url", "title")


def stream_articles(spark, sf):
    """Arriving documents kept up to date in an articles table, for several keywords."""
    out, state = _new_path(spark, "articles"), _new_path(spark, "state")
    stream = ps.stream_documents(spark, _arriving(spark, sf), files_per_batch=2)
    ps.stream_articles(stream, sites_table(spark, sf), KEYWORDS, out, state, scraped_at=STAMP).awaitTermination()
    return ps.articles_table(spark, out).read().select(*ps.ARTICLE_FIELDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_text, strip_accents, keyword_search, keyword_column, iso_dates, iso_timestamps, url_parts,
        slug_text, article_url, page_titles, gathered_pages, jsonld_flatten, page_metadata, real_authors,
        sitemap_entries, sitemap_index, sitemap_expansion, sitemap_budget, scan_limit, robots_rules,
        robots_verdict, robots_delays, interleave_cap, interleave_all, keep_first, first_success,
        usable_documents, discover, resolve_articles, search, search_many, discover_table, search_table, search_funnel, article_report,
        append_new, upsert, save_articles, selected_sites, stream_entries, stream_articles,
    )
}
