"""JSON-LD blocks as VARIANT values: flattening, picking and field access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import _col, bind, nonblank

# Schema.org article types, most wanted first.
ARTICLE_TYPES = (
    "newsarticle",
    "reportagenewsarticle",
    "article",
    "blogposting",
    "liveblogposting",
    "report",
)


def _depth(json: Column) -> Column:
    """More than the lists that can be nested in ``json``: its opening brackets."""
    return F.coalesce(F.length(json) - F.length(F.replace(json, F.lit("["), F.lit(""))), F.lit(0)) + 1


def _until_closed(nodes: Column, depth: Column, step) -> Column:
    """``step`` applied until no node is open, ``depth`` times at most."""
    return F.aggregate(
        F.sequence(F.lit(1), depth),
        nodes,
        lambda open_nodes, _: F.when(F.exists(open_nodes, lambda n: n["open"]), step(open_nodes)).otherwise(open_nodes),
    )


def _elements(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _parsed(block: Column) -> Column:
    """The value of a block, NULL if it is no JSON.

    The parser stops after the first value; inside brackets, whatever follows
    it is an error or a second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
    return bind(_elements(wrapped), lambda values: F.when(F.size(values) == 1, F.get(values, F.lit(0))))


def _expand_once(nodes: Column) -> Column:
    """Open every list and ``@graph`` list among the nodes still open."""

    def step(node: Column) -> Column:
        listed = F.when(node["open"], _elements(node["v"]))
        graph = F.when(node["open"], _elements(node["v"], "$['@graph']"))
        children = F.transform(
            F.coalesce(listed, graph, F.array().cast("array<variant>")),
            lambda v, i: F.struct(
                F.concat(node["path"], F.array(-i)).alias("path"), v.alias("v"), F.lit(True).alias("open")
            ),
        )
        closed = F.array(F.struct(node["path"].alias("path"), node["v"].alias("v"), F.lit(False).alias("open")))
        return F.when(listed.isNull(), F.concat(closed, children)).otherwise(children)

    return F.flatten(F.transform(nodes, step))


def _flat(blocks: Column) -> Column:
    """Everything in the blocks, unordered; ``path`` gives the order.

    Blocks go forward and siblings inside a block backward, a container before
    its graph; hence the negated positions. A block that is no JSON is dropped.
    """
    roots = F.transform(
        blocks,
        lambda b, i: F.struct(
            F.array(i).alias("path"), _parsed(b).alias("v"), F.lit(True).alias("open")
        ),
    )
    nodes = F.filter(roots, lambda n: n["v"].isNotNull())
    depth = F.coalesce(F.array_max(F.transform(blocks, _depth)), F.lit(1))
    return _until_closed(nodes, depth, _expand_once)


@built_once
def jsonld_nodes(blocks: Column | str) -> Column:
    """``array<struct<path, v>>`` of all object nodes, in order."""
    objects = F.filter(_flat(_col(blocks)), lambda n: _is_object(n["v"]))
    ordered = F.array_sort(
        objects,
        lambda a, b: F.when(a["path"] < b["path"], F.lit(-1)).when(a["path"] > b["path"], F.lit(1)).otherwise(0),
    )
    return F.transform(ordered, lambda n: F.struct(n["path"].alias("path"), n["v"].alias("v")))


def node_types(node: Column) -> Column:
    """Lower-cased ``@type`` values."""
    many = F.try_variant_get(node, "$['@type']", "array<string>")
    one = F.try_variant_get(node, "$['@type']", "string")
    types = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    return F.transform(types, lambda t: F.lower(t))


@built_once
def pick_article_node(blocks: Column | str) -> Column:
    """The VARIANT node of the most wanted type, first in order within it."""
    wanted = F.array(*[F.lit(t) for t in ARTICLE_TYPES])

    def rank(node: Column) -> Column:
        return F.array_min(
            F.transform(node_types(node), lambda t: F.nullif(F.array_position(wanted, t), F.lit(0).cast("bigint")))
        )

    ranked = F.filter(
        F.transform(
            _flat(_col(blocks)),
            lambda n: F.struct(rank(n["v"]).alias("rank"), n["path"].alias("path"), n["v"].alias("v")),
        ),
        lambda n: n["rank"].isNotNull(),
    )
    first = F.aggregate(
        ranked,
        F.lit(None).cast("struct<rank:bigint,path:array<int>,v:variant>"),
        lambda best, n: F.when(
            best.isNull() | (F.struct(n["rank"], n["path"]) < F.struct(best["rank"], best["path"])), n
        ).otherwise(best),
    )
    return F.when(F.size(_col(blocks)) > 0, first["v"])


def _string(value: Column) -> Column:
    """Trimmed text of a JSON string; other types and blanks are missing."""
    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    return nonblank(bind(value, text))


def jsonld_field(node: Column | str, name: str) -> Column:
    return F.try_variant_get(_col(node), f"$['{name}']", "variant")


@built_once
def jsonld_string(node: Column | str, name: str) -> Column:
    return _string(jsonld_field(node, name))


def _leaves(value: Column) -> Column:
    """What is no list inside a value's nested lists, with its ``path``."""

    def step(nodes: Column) -> Column:
        def opened(node: Column) -> Column:
            listed = F.when(node["open"], _elements(node["v"]))
            return F.when(
                listed.isNull(),
                F.array(F.struct(node["path"].alias("path"), node["v"].alias("v"), F.lit(False).alias("open"))),
            ).otherwise(
                F.transform(
                    listed,
                    lambda v, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), v.alias("v"), F.lit(True).alias("open")),
                )
            )

        return F.flatten(F.transform(nodes, opened))

    root = F.struct(F.array().cast("array<int>").alias("path"), value.alias("v"), F.lit(True).alias("open"))
    return _until_closed(F.array(root), _depth(F.to_json(value)), step)


def _texts(value: Column, from_object) -> Column:
    """``array<struct<path, text>>`` of the leaves that have a text, in order."""

    def text(v: Column) -> Column:
        return F.coalesce(_string(v), F.when(_is_object(v), from_object(v)))

    texts = F.transform(_leaves(value), lambda n: F.struct(n["path"].alias("path"), bind(n["v"], text).alias("text")))
    return F.array_sort(F.filter(texts, lambda n: n["text"].isNotNull()))


def _joined(level: Column, entries: Column) -> Column:
    """Entries with those of each list at ``level`` joined to one, each text once."""

    def add(groups: Column, entry: Column) -> Column:
        inside = F.size(entry["path"]) >= level
        path = F.when(inside, F.slice(entry["path"], F.lit(1), level - 1)).otherwise(entry["path"])
        last = F.element_at(groups, F.lit(-1))
        one = F.struct(path.alias("path"), F.array(entry["text"]).alias("texts"))
        more = F.struct(path.alias("path"), F.concat(last["texts"], F.array(entry["text"])).alias("texts"))
        same = inside & (F.size(groups) > 0) & (F.try_element_at(groups, F.lit(-1))["path"] == path)
        return F.when(same, F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(more))).otherwise(
            F.concat(groups, F.array(one))
        )

    groups = F.aggregate(entries, F.array().cast("array<struct<path:array<int>,texts:array<string>>>"), add)
    return F.transform(
        groups, lambda g: F.struct(g["path"].alias("path"), F.array_join(F.array_distinct(g["texts"]), ", ").alias("text"))
    )


@built_once
def jsonld_name(value: Column | str) -> Column:
    """Author name: a string, an object's name, or the distinct names of a list; lists nest to any depth."""

    def name(entries: Column) -> Column:
        deepest = F.coalesce(F.array_max(F.transform(entries, lambda e: F.size(e["path"]))), F.lit(0))
        levels = F.filter(F.sequence(deepest, F.lit(0)), lambda level: level > 0)
        one = F.aggregate(levels, entries, lambda rest, level: _joined(level, rest))
        return F.nullif(F.get(one, F.lit(0))["text"], F.lit(""))

    return bind(_texts(_col(value), lambda v: jsonld_string(v, "name")), name)


@built_once
def jsonld_url(value: Column | str) -> Column:
    """Image URL: a string, an object's URL, or the first of a list; lists nest to any depth."""
    texts = _texts(_col(value), lambda v: F.coalesce(jsonld_string(v, "url"), jsonld_string(v, "contentUrl")))
    return F.get(texts, F.lit(0))["text"]
