"""URL scalar functions over the generic URI syntax (RFC 3986)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import _col, bind, trim_space

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def url_netloc(url: Column | str) -> Column:
    """Authority with port and user info, ``''`` if there is none."""
    return F.regexp_extract(_col(url), _AUTHORITY, 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _PATH, 1)


@built_once
def url_origin(url: Column | str) -> Column:
    """``scheme://netloc``; unlike a bare host it keeps the port."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def path_segments(url: Column | str) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def last_segment(url: Column | str) -> Column:
    """Last non-empty path segment, ``''`` if there is none."""
    return F.regexp_extract(url_path(url), r"([^/]*)/*$", 1)


@built_once
def percent_decode(text: Column | str) -> Column:
    """Decode ``%XX``; ``+`` stays a plus and a broken escape stays as it is."""

    def decoded(t: Column) -> Column:
        guarded = F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25")
        guarded = F.replace(guarded, F.lit("+"), F.lit("%2B"))
        return F.when(F.contains(t, F.lit("%")), F.url_decode(guarded)).otherwise(t)

    return bind(text, decoded)


@built_once
def humanize_slug(slug: Column | str) -> Column:
    """Slug to words: decode, turn ``-`` and ``_`` into spaces, trim."""
    return trim_space(F.translate(percent_decode(slug), "-_", "  "))


@built_once
def slug_text(url: Column | str, strip_regex: Column | str | None = None) -> Column:
    """Words of the last segment, after removing an outlet's trailing code.

    ``strip_regex`` is a column of patterns (NULL: nothing to strip).
    """
    segment = last_segment(url)
    if strip_regex is not None:
        never = F.lit("(?!)")
        segment = F.regexp_replace(segment, F.coalesce(_col(strip_regex), never), F.lit(""))
    return humanize_slug(segment)


@built_once
def is_article_url(
    url: Column | str,
    host_token: Column | str,
    match_on: Column | str,
    article_regex: Column | str,
) -> Column:
    """The host contains ``host_token`` and the path shape is an article's.

    ``match_on`` says whether the pattern is tried on the whole ``path`` or on
    the ``last_segment``.
    """
    subject = F.when(_col(match_on) == "path", url_path(url)).otherwise(last_segment(url))
    return F.contains(url_netloc(url), _col(host_token)) & F.regexp_like(subject, _col(article_regex))
