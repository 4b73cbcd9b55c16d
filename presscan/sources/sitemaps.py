"""Sitemap XML to rows.

Every document is parsed where it is scanned; only narrow facts about it (is it
an index, its children, how many entries it has) take part in the joins that
expand indexes. Bodies are read again for the documents that are really used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import _col, bind, nonblank
from presscan.functions.urls import url_origin
from presscan.operators.robots import robots_verdict
from presscan.session import stored
from presscan.schema import KIND_SITEMAP, MAX_INDEX_DEPTH, USER_AGENT
from presscan.sources.documents import first_per_key, usable_documents

# The text of an element that should only hold children goes to ``_VALUE``; the
# parser cannot place it otherwise. The corrupt-record column must come last.
_ENTRY = (
    "struct<_VALUE:string,loc:array<string>,lastmod:array<string>,"
    "news:array<struct<_VALUE:string,title:array<string>,publication_date:array<string>>>,"
    "image:array<struct<_VALUE:string,loc:array<string>>>>"
)
_TREE = f"sitemap array<struct<_VALUE:string,loc:array<string>>>, url array<{_ENTRY}>, _corrupt string"
# The same entries as text, which keeps the order of siblings.
_BLOCKS = "url array<string>, _corrupt string"
_XML_OPTIONS = {
    "ignoreNamespace": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
}

_MISC = r"(?:\s++|<!--.*?-->|<\?(?!xml\s).*?\?>)*+"
_DOCTYPE = r"(?:<!DOCTYPE[^\[>]*+(?:\[.*?\]\s*+)?>)?+"
_PROLOG = rf"^\x{{feff}}?(?:<\?xml\s.*?\?>)?+{_MISC}{_DOCTYPE}{_MISC}"
_ROOT = rf"(?s){_PROLOG}<(?:[\w.\-]+:)?([\w.\-]+)"
#: The root element closes at the end of the document.
_CLOSED = rf"(?s)(?:</(?:[\w.\-]+:)?([\w.\-]+)\s*>|/>){_MISC}$"



@built_once
def root_name(xml: Column | str) -> Column:
    """Local name of the root element, ``''`` if there is none."""
    return F.regexp_extract(_col(xml), _ROOT, 1)


def _text(values: Column) -> Column:
    """Trimmed text of the first element of that name; a blank one is NULL."""
    return nonblank(F.get(values, F.lit(0)))


def _first_of(items: Column, pick) -> Column:
    return F.get(F.filter(F.transform(items, pick), lambda v: v.isNotNull()), F.lit(0))


@built_once
def _parsed(xml: Column | str, schema: str) -> Column:
    def tree(text: Column) -> Column:
        body = F.regexp_replace(text, rf"(?s)({_PROLOG})(?=<)", "")
        return F.from_xml(F.when(_single_root(text), body), schema, _XML_OPTIONS)

    return bind(_prepared(_col(xml)), tree)


# The names of elements that hold data.
_NAMES = "url|loc|lastmod|news|title|publication_date|image|sitemap"
#: A tag whose name differs from those in case only; the parser would not tell it apart.
_OTHER_CASE = rf"(</?(?:[\w.\-]+:)?)(?!(?:{_NAMES})[\s/>])((?i:{_NAMES})[\s/>])"
_ENTITY = r"""<!ENTITY\s+([\w.\-:]+)\s+("[^"]*"|'[^']*')\s*>"""
#: Text and markup, and what must stay as it is: CDATA sections and comments.
_SECTIONS = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|(?:[^<]++|<(?!!\[CDATA\[|!--))++"
#: Characters that a document may grow to by its entities.
MAX_EXPANDED = 8 << 20


def _prepared(xml: Column) -> Column:
    """The document with its internal entities expanded and tags of other case renamed; most need neither.

    NULL if an entity holds itself, or if the text would grow too long.
    """

    def expanded(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
        entities = F.transform(
            found,
            lambda e: F.struct(
                F.concat(F.lit("&"), F.regexp_extract(e, _ENTITY, 1), F.lit(";")).alias("name"),
                F.regexp_replace(F.regexp_extract(e, _ENTITY, 2), r"(?s)^.|.$", "").alias("value"),
            ),
        )
        # Of two declarations of a name the first counts: it is replaced first.
        body = F.regexp_replace(text, rf"(?s)^({_PROLOG})(?=<)", "")

        def replaced(part: Column, e: Column) -> Column:
            # The length is known before the text is made.
            rest = F.length(F.replace(part, e["name"], F.lit("")))
            uses = (F.length(part) - rest) / F.length(e["name"])
            return F.when(rest + uses * F.length(e["value"]) <= MAX_EXPANDED, F.replace(part, e["name"], e["value"]))

        def once(part: Column, known: Column) -> Column:
            return F.aggregate(known, part, replaced)

        def open_(part: Column, known: Column) -> Column:
            rounds = F.aggregate(F.sequence(F.lit(1), F.size(known)), part, lambda acc, _: once(acc, known))
            closed = ~F.exists(known, lambda e: F.contains(rounds, e["name"]))
            return F.when(F.size(known) == 0, part).otherwise(F.when(closed, rounds))

        def section(part: Column, known: Column) -> Column:
            other = F.regexp_replace(open_(part, known), _OTHER_CASE, "$1_$2")
            return F.when(F.startswith(part, F.lit("<!")), part).otherwise(other)

        def joined(known: Column) -> Column:
            parts = F.transform(F.regexp_extract_all(body, F.lit(_SECTIONS), F.lit(0)), lambda p: section(p, known))
            return bind(parts, lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), F.array_join(p, "")))

        return bind(entities, joined)

    odd = F.contains(xml, F.lit("<!ENTITY")) | F.regexp_like(xml, F.lit(_OTHER_CASE))
    return F.when(odd, bind(xml, expanded)).otherwise(xml)


def _single_root(xml: Column) -> Column:
    """A root element opens after the prolog and the document ends with it."""
    closing = F.regexp_extract(xml, _CLOSED, 1)
    same = F.exists(
        F.array(F.struct(root_name(xml).alias("opened"), closing.alias("closed"))),
        lambda r: (r["opened"] != "") & ((r["closed"] == r["opened"]) | (r["closed"] == "")),
    )
    return same & F.regexp_like(xml, F.lit(_CLOSED))


def _well_formed(tree: Column) -> Column:
    return tree.isNotNull() & tree["_corrupt"].isNull()


@built_once
def is_sitemap_index(xml: Column | str) -> Column:
    """The root is a ``sitemapindex`` and the document is well formed."""
    xml = _col(xml)
    return (root_name(xml) == "sitemapindex") & bind(_parsed(xml, _TREE), _well_formed)


def _children(tree: Column) -> Column:
    locs = F.transform(F.coalesce(tree["sitemap"], F.array()), lambda s: _text(s["loc"]))
    return F.filter(locs, lambda u: u.isNotNull())


def _located(tree: Column) -> Column:
    return F.filter(F.coalesce(tree["url"], F.array()), lambda u: _text(u["loc"]).isNotNull())


def sitemap_children(documents: DataFrame, body: str = "body") -> DataFrame:
    """``(source_sitemap, child_ord, url)`` for every child of an index."""
    tree = documents.where(F.contains(F.col(body), F.lit("<"))).select(
        F.col("url").alias("source_sitemap"), _parsed(body, _TREE).alias("_tree")
    )
    children = F.when(_well_formed(F.col("_tree")), _children(F.col("_tree")))
    return _exploded(tree, children, ["source_sitemap"], "child_ord", "url")


def _exploded(df: DataFrame, items: Column, keep: list[str], position: str, item: str) -> DataFrame:
    """One row per item.

    The outer form keeps Catalyst from adding a filter on ``items``, which
    would parse every document a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return rows.where(F.col(item).isNotNull())


def _published(entry: Column, block: Column) -> Column:
    """The first date in document order, of ``lastmod`` and the news date."""
    lastmod = _first_of(entry["lastmod"], nonblank)
    news = _first_of(entry["news"], lambda n: _text(n["publication_date"]))
    lastmod_at, news_at = (F.regexp_instr(block, F.lit(_filled(tag))) for tag in ("lastmod", "publication_date"))
    news_first = (news_at > 0) & ((lastmod_at == 0) | (news_at < lastmod_at))
    return F.when(news_first, F.coalesce(news, lastmod)).otherwise(F.coalesce(lastmod, news))


def _filled(tag: str) -> str:
    """Pattern of a tag that holds more than white space."""
    return rf"<(?:[\w.\-]+:)?{tag}(?:\s[^>]*)?(?<!/)>\s*(?:<!\[CDATA\[\s*)?[^\s<\]]"


def sitemap_entries(documents: DataFrame, body: str = "body", carry: tuple[str, ...] = ()) -> DataFrame:
    """Entries of url-sets, one row each, in document order.

    Row-local, hence usable on a stream as well. ``carry`` names columns to keep.
    """
    keep = ["source_sitemap", *carry]
    parsed = _with_trees(documents.withColumn("source_sitemap", F.col("url")), body, keep)
    rows = _exploded(parsed, _entries("_tree", "_blocks"), keep, "entry_ord", "_entry")
    return rows.select(*carry, "source_sitemap", "_entry.*", "entry_ord")


def _with_trees(documents: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """``keep``, ``_tree`` and, where the order of dates matters, ``_blocks`` of documents that may be XML."""
    xml = F.col(body)
    both_dates = F.contains(xml, F.lit("lastmod")) & F.contains(xml, F.lit("publication_date"))
    return documents.where(F.contains(xml, F.lit("<"))).select(
        *keep,
        _parsed(body, _TREE).alias("_tree"),
        F.when(both_dates, _parsed(body, _BLOCKS)["url"]).alias("_blocks"),
    )


iter_entries = sitemap_entries


@built_once
def _entries(tree_name: str, blocks_name: str) -> Column:
    """Entries of a parsed document; NULL if it is malformed."""
    tree = F.col(tree_name)
    blocks = F.coalesce(F.col(blocks_name), F.transform(tree["url"], lambda _: F.lit("")))
    entries = F.transform(
        F.filter(
            F.arrays_zip(tree["url"].alias("e"), blocks.alias("b")),
            lambda p: _text(p["e"]["loc"]).isNotNull(),
        ),
        lambda p: F.struct(
            _text(p["e"]["loc"]).alias("url"),
            _first_of(p["e"]["news"], lambda n: _text(n["title"])).alias("title"),
            _published(p["e"], p["b"]).alias("published_at"),
            _first_of(p["e"]["image"], lambda i: _text(i["loc"])).alias("image_url"),
        ),
    )
    return F.when(_well_formed(tree), entries)


def sitemap_catalog(documents: DataFrame) -> DataFrame:
    """Narrow facts per sitemap: ``(url, fetched_at, is_index, children, n_entries)``."""
    tree = F.col("_tree")
    facts = (
        _readable(documents)
        .select(
            "url",
            "fetched_at",
            (root_name("body") == "sitemapindex").alias("_is_index"),
            _parsed("body", _TREE).alias("_tree"),
        )
        .select(
            "url",
            "fetched_at",
            F.col("_is_index").alias("is_index"),
            F.when(F.col("_is_index") & _well_formed(tree), _children(tree)).alias("children"),
            F.when(~F.col("_is_index") & _well_formed(tree), F.size(_located(tree)))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("n_entries"),
        )
    )
    return first_per_key(facts, ["url"], [F.col("fetched_at")])


def _readable(documents: DataFrame) -> DataFrame:
    """A text resource is requested once, so only the first attempt counts, numbered from 1 or from 0."""
    usable = usable_documents(documents, KIND_SITEMAP)
    return usable.where(F.col("body").isNotNull() & (F.col("attempt") <= 1))


def leaf_entries(leaves: DataFrame, documents: DataFrame, take: str | None = None) -> DataFrame:
    """Entries of the url-sets in ``leaves``, with their ``site_ord`` and ``path``.

    Documents no leaf asks for are dropped before they are parsed, and the others parsed where they
    are scanned: only entries are compared and joined, never bodies.
    """
    wanted = _readable(documents).join(leaves.select("url"), "url", "left_semi")
    parsed = _with_trees(wanted.select("url", "fetched_at", "body"), "body", ["url", "fetched_at"])
    listed = parsed.select("url", "fetched_at", _entries("_tree", "_blocks").alias("_list"))
    first = first_per_key(listed, ["url"], [F.col("fetched_at")])
    items = F.slice("_list", F.lit(1), F.col(take).cast("int")) if take else F.col("_list")
    carry = ["site_ord", "path"]
    rows = leaves.join(first, "url").select(*carry, F.col("url").alias("source_sitemap"), items.alias("_list"))
    rows = _exploded(rows, F.col("_list"), [*carry, "source_sitemap"], "entry_ord", "_entry")
    return rows.select(*carry, "source_sitemap", "_entry.*", "entry_ord")


def of_origins(urls: DataFrame, origins: DataFrame) -> DataFrame:
    """Rows whose ``url`` belongs to one of the origins."""
    located = urls.withColumn("_origin", url_origin("url"))
    return located.join(origins.select(F.col("origin").alias("_origin")), "_origin", "left_semi").select(*urls.columns)


def expand_sitemaps(
    roots: DataFrame,
    catalog: DataFrame | Callable[[DataFrame], DataFrame],
    rules: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    max_depth: int = MAX_INDEX_DEPTH,
    user_agent: str = USER_AGENT,
    asked: DataFrame | None = None,
) -> DataFrame:
    """Url-sets reached from the roots: ``(site_ord, path, url, n_entries)``.

    Catalog and rules are tables, or what gives the part of them that some URLs need: then a level
    is read when it is reached, and nothing else is. A catalog given as a table is stored first, so
    its sitemaps are parsed once and not again at every level.

    With ``asked`` (column ``origin``) only sitemaps of those origins are opened: the others
    wait until it is known what their robots file says.

    ``path`` holds the position among siblings at every level, so ordering by
    it is the depth-first order of a reader that opens indexes in place. A
    sitemap reached twice is there twice. The depth is fixed, so the joins are
    unrolled; a level feeds both the result and the next level, hence stored.
    """
    if not callable(catalog):
        once = stored(catalog.select("url", "is_index", "children", "n_entries"))
    facts_of = catalog if callable(catalog) else lambda _: once
    rules_of = rules if callable(rules) or rules is None else lambda _: rules
    frontier = roots.select("site_ord", "path", "url")
    leaves = None
    for depth in range(max_depth + 1):
        if rules_of is not None:
            frontier = robots_verdict(frontier, rules_of(frontier), user_agent).where("allowed").drop("allowed", "delay")
        if asked is not None:
            frontier = of_origins(frontier, asked)
        found = frontier.join(facts_of(frontier).select("url", "is_index", "children", "n_entries"), "url")
        if depth < max_depth:
            found = stored(found)
        level = found.where(~F.col("is_index") & (F.col("n_entries") > 0)).select(
            "site_ord", "path", "url", "n_entries"
        )
        leaves = level if leaves is None else leaves.unionByName(level)
        if depth < max_depth:
            frontier = (
                _exploded(found.where("is_index"), F.col("children"), ["site_ord", "path"], "_pos", "url")
                .select("site_ord", F.concat("path", F.array("_pos")).alias("path"), "url")
            )
    return leaves
