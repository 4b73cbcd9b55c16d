"""Keyword news discovery and article metadata on Spark DataFrames."""

from presscan.functions.dates import to_iso8601
from presscan.functions.jsonld import jsonld_name, jsonld_nodes, jsonld_url, pick_article_node
from presscan.functions.markup import gather_page, page_title, unescape_html
from presscan.functions.text import (
    first_nonblank,
    keyword_matches,
    keyword_tokens,
    normalize_text,
    strip_accents,
)
from presscan.functions.urls import (
    humanize_slug,
    is_article_url,
    last_segment,
    path_segments,
    slug_text,
    url_origin,
)
from presscan.operators.matching import match_entries
from presscan.operators.ranking import interleave, keep_first, limit_scan
from presscan.operators.resolve import article_report, resolve_articles, search_funnel
from presscan.operators.robots import robots_delays, robots_policies, robots_rules, robots_verdict
from presscan.plans.search import SearchOptions, discover, funnel, search, search_many
from presscan.schema import ARTICLE_FIELDS, ARTICLE_SCHEMA, DOCUMENT_SCHEMA
from presscan.session import build_session, configure
from presscan.sinks import UpsertTable, append_new, read_csv, save_articles, upsert, write_all
from presscan.sources.documents import article_pages, first_success, read_documents, usable_documents
from presscan.sources.pages import first_page_metadata, is_real_author, page_metadata, resolve_metadata
from presscan.sources.sitemaps import expand_sitemaps, is_sitemap_index, sitemap_children, sitemap_entries
from presscan.sources.sites import available_sites, select_sites, sitemap_roots
from presscan.streaming.articles import articles_table, read_entries, stream_articles, stream_documents, stream_entries

__all__ = [name for name in dir() if not name.startswith("_")]
