"""The first keyword filter, on cheap sitemap data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import bind, constant_tokens, contains_tokens, haystack, keyword_tokens
from presscan.functions.urls import is_article_url, slug_text
from presscan.session import stored


@built_once
def _entry_text() -> Column:
    return haystack("title", slug_text("url", "slug_strip_regex"))


#: Characters of the runs that keywords are looked up by.
GRAM = 3


@built_once
def _grams(text: Column | str, width: Column | int) -> Column:
    """The distinct runs of ``width`` characters of a text."""
    width = F.lit(width) if isinstance(width, int) else width

    def runs(chars: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - width + 1)
        found = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(chars, i, width), "")))
        return F.when(F.size(chars) >= width, found).otherwise(F.array().cast("array<string>"))

    return bind(F.split(text, ""), runs)


def _shaped(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """Entries that may be articles: those with a title, and those whose URL looks like one."""
    dimension = sites.select(
        "site_ord", "site_key", "host_token", "article_match_on", "article_regex", "slug_strip_regex"
    )
    return entries.join(dimension, "site_ord").where(
        F.col("title").isNotNull() | is_article_url("url", "host_token", "article_match_on", "article_regex")
    )


def match_entries(entries: DataFrame, sites: DataFrame, keywords: str | Sequence[str] | DataFrame) -> DataFrame:
    """Entries whose title or slug holds every token of a keyword.

    An entry with a title is an article; one without must look like one by its
    URL. Adds ``site_key`` and ``keyword``. Several keywords are tried against
    the same folded text, so an entry is folded once however many there are. A table
    of keywords (column ``keyword``) may have any size, see :func:`match_keyword_table`.
    """
    shaped = _shaped(entries, sites)
    text = _entry_text()
    kept = [*entries.columns, "site_key"]
    if isinstance(keywords, str):
        return shaped.where(contains_tokens(text, constant_tokens(keywords))).select(
            *kept, F.lit(keywords).alias("keyword")
        )
    folded = shaped.select(*kept, text.alias("_text"))
    if isinstance(keywords, DataFrame):
        return match_keyword_table(folded, keywords, "_text").select(*kept, "keyword")
    # One constant, whatever its length: the plan does not grow with the keywords.
    asked = [{"keyword": k, "tokens": constant_tokens(k)} for k in dict.fromkeys(keywords)]
    known = F.from_json(F.lit(json.dumps(asked)), "array<struct<keyword:string,tokens:array<string>>>")
    found = F.filter(
        known, lambda k: (F.size(k["tokens"]) > 0) & F.forall(k["tokens"], lambda t: F.contains(F.col("_text"), t))
    )
    hits = F.transform(found, lambda k: k["keyword"])
    return folded.select(*kept, F.explode(hits).alias("keyword"))


def match_keyword_table(texts: DataFrame, keywords: DataFrame, text: str) -> DataFrame:
    """``texts`` once for every keyword of the table whose tokens all occur in the folded column ``text``.

    A substring join without trying all pairs. A keyword is looked up by one run of
    characters of its tokens, the one that the fewest texts have (three characters, fewer only
    where no token is that long); a text by all of its runs. What meets by a run is verified on
    all tokens. Keywords with a run that no text has go before the join. Only texts'
    numbers travel with their runs, and how the join is done is Spark's choice by size.
    Repeated keywords count once; a blank or null keyword matches nothing.
    """
    asked = keywords.select("keyword").distinct().withColumn("_tokens", keyword_tokens("keyword")).where(F.size("_tokens") > 0)
    longest = F.array_max(F.transform("_tokens", F.char_length))
    asked = stored(asked.withColumn("_width", F.least(F.lit(GRAM), longest)))
    widths = sorted(r["_width"] for r in asked.select("_width").distinct().collect())  # GRAM at most
    numbered = stored(texts.withColumn("_number", F.monotonically_increasing_id()))
    none = F.array().cast("array<string>")
    runs = F.flatten(F.array(none, *[_grams(text, w) for w in widths]))
    runs = numbered.select("_number", F.explode(runs).alias("_run"))

    of_keyword = F.flatten(F.transform(F.filter("_tokens", lambda t: F.char_length(t) >= F.col("_width")), lambda t: _grams(t, F.col("_width"))))
    offered = asked.select("keyword", F.explode(F.array_distinct(of_keyword)).alias("_run"))
    met = offered.join(runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n")), "_run", "left")
    rarest = met.groupBy("keyword").agg(F.min_by(F.struct("_run", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_run")).alias("_key"))
    looked_up = rarest.where(F.col("_key._n") > 0).select("keyword", F.col("_key._run").alias("_run"))
    looked_up = stored(looked_up.join(asked.select("keyword", "_tokens"), "keyword"))

    pairs = runs.join(looked_up, "_run").select("_number", "keyword", "_tokens")
    verified = F.forall("_tokens", lambda t: F.contains(F.col(text), t))
    return numbered.join(pairs, "_number").where(verified).select(*texts.columns, "keyword")
