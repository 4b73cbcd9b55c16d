"""HTML snapshots to the raw inputs of metadata resolution.

One regular expression cuts a page into the tokens that matter. Elements whose
content is not markup (scripts, styles, comments ...) are tokens as a whole, so
tags inside them are never seen. All repetitions over text are possessive or
lazy over single characters, which Java matches without recursion.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import _col, bind, trim_space

# White space of HTML, and what script text is trimmed of.
_HTML_SPACE = "\t\n\f\r "
_SCRIPT_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_RAW = "script|style|textarea|noscript|template|iframe|xmp|noembed|noframes"
_END = r"(?=[\s/>])"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
_ATTRIBUTE = rf"[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+"
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE}|=)*+"

TOKEN = (
    r"(?is)<(?:"
    r"!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|({_RAW}){_END}{_ATTRIBUTES}>.*?(?:</\1{_END}[^>]*+>|\z)"
    rf"|title{_END}{_ATTRIBUTES}>.*?</title{_END}[^>]*+>"
    rf"|meta{_END}{_ATTRIBUTES}>"
    r")"
)


def _attribute(tag: Column, name: str) -> Column:
    """Raw value of the first attribute of that name, ``''`` if absent."""
    pattern = (
        rf"(?is)^<[a-z]+(?:[\s/]++|(?!{name}[\s=/>]){_ATTRIBUTE}|=)*+"
        rf"{name}(?=[\s=/>])\s*+=\s*+({_VALUE})"
    )

    def unquoted(raw: Column) -> Column:
        quoted = F.substring(raw, 1, 1).isin('"', "'")
        return F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    return bind(F.regexp_extract(tag, pattern, 1), unquoted)


@cache
def _references() -> tuple[str, str, str]:
    """Names, their characters, and the names that need no semicolon."""
    names = sorted(n.rstrip(";") for n in html5 if n.endswith(";"))
    legacy = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "\n".join(names), "\n".join(html5[n + ";"].replace("\n", "\r") for n in names), "|".join(legacy)


def _numeric(digits: Column, base: int) -> Column:
    """The character of a numeric reference.

    128 to 159 are read as Windows-1252; what is no character becomes U+FFFD.
    """
    western = F.lit("".join(_windows_1252(i) for i in range(128, 160)))

    def character(code: Column) -> Column:
        bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return (
            F.when(bad, F.lit("\ufffd"))
            .when(code.between(128, 159), F.substring(western, (code - 127).cast("int"), F.lit(1)))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    significant = F.ltrim(digits, F.lit("0"))
    code = F.when(F.length(significant) <= 8, F.conv(digits, base, 10).try_cast("bigint"))
    return bind(code, character)


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _dereference(ref: Column, in_attribute: bool) -> Column:
    names, values, legacy = _references()

    def named(name: Column) -> Column:
        """The characters of a name, NULL if there is no such name."""
        return bind(
            F.array_position(F.split(F.lit(names), "\n"), name),
            lambda at: F.when(
                at > 0, F.translate(F.get(F.split(F.lit(values), "\n"), (at - 1).cast("int")), "\r", "\n")
            ),
        )

    value = F.when(F.contains(ref, F.lit(";")), named(F.regexp_extract(ref, "^&([A-Za-z0-9]*)", 1)))
    closed = F.contains(ref, F.lit(";"))
    if in_attribute:
        # Without a semicolon and before a letter, digit or ``=`` it is text.
        prefix = F.when(~closed & ~ref.endswith("="), F.regexp_extract(ref, f"^&({legacy})$", 1))
    else:
        prefix = F.regexp_extract(ref, f"^&({legacy})", 1)
    by_prefix = bind(prefix, lambda p: F.concat(named(p), F.substring(ref, F.length(p) + 2, F.length(ref))))
    result = F.when(ref == "&amp;", F.lit("&"))
    for entity in ("quot", "lt", "gt", "apos", "nbsp"):
        result = result.when(ref == f"&{entity};", F.lit(html5[entity + ";"]))
    return (
        result.when(ref.rlike("^&#[0-9]"), _numeric(F.regexp_extract(ref, "([0-9]+)", 1), 10))
        .when(ref.rlike("^&#[xX]"), _numeric(F.regexp_extract(ref, "^&#[xX]([0-9A-Fa-f]+)", 1), 16))
        .otherwise(F.coalesce(value, by_prefix, ref))
    )


@built_once
def unescape_html(text: Column | str, in_attribute: bool = False) -> Column:
    """Decode character references; text without ``&`` is passed through."""
    tail = "=?" if in_attribute else ""
    pattern = f"&(?:#[0-9]++;?|#[xX][0-9A-Fa-f]++;?|[A-Za-z][A-Za-z0-9]*+;?{tail})"

    def woven(t: Column) -> Column:
        parts = F.zip_with(
            F.split(t, pattern),
            F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
            lambda piece, ref: F.concat(piece, F.coalesce(_dereference(ref, in_attribute), F.lit(""))),
        )
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    return bind(text, woven)


@built_once
def page_tokens(html: Column | str) -> Column:
    """The tokens of a page, line ends normalised as an HTML parser does."""
    html = _col(html)
    lines = F.when(F.contains(html, F.lit("\r")), F.regexp_replace(html, "\r\n?", "\n")).otherwise(html)
    return F.regexp_extract_all(lines, F.lit(TOKEN), F.lit(0))


def _of_kind(tokens: Column, tag: str) -> Column:
    return F.filter(tokens, lambda t: F.regexp_like(t, F.lit(f"(?i)^<{tag}{_END}")))


def _element_text(token: Column, tag: str) -> Column:
    opened = F.regexp_replace(token, rf"(?is)^<{tag}{_END}{_ATTRIBUTES}>", "")
    return F.regexp_replace(opened, rf"(?is)</{tag}{_END}[^>]*+>\z", "")


def _ldjson(tokens: Column) -> Column:
    scripts = F.filter(
        _of_kind(tokens, "script"), lambda t: F.lower(_attribute(t, "type")) == "application/ld+json"
    )
    bodies = F.transform(scripts, lambda t: trim_space(_element_text(t, "script"), _SCRIPT_SPACE))
    return F.filter(bodies, lambda b: b != "")


def _meta(tokens: Column) -> Column:
    def first_key(tag: Column) -> Column:
        return F.coalesce(
            *[F.nullif(_attribute(tag, n), F.lit("")) for n in ("property", "name", "itemprop")], F.lit("")
        )

    pairs = F.transform(
        _of_kind(tokens, "meta"),
        lambda t: F.struct(
            unescape_html(first_key(t), in_attribute=True).alias("key"),
            unescape_html(_attribute(t, "content"), in_attribute=True).alias("content"),
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["content"] != ""))


def _doc_title(tokens: Column) -> Column:
    title = unescape_html(_element_text(F.get(_of_kind(tokens, "title"), F.lit(0)), "title"))
    collapsed = F.trim(F.regexp_replace(title, f"[{_HTML_SPACE}]+", " "))
    return F.nullif(collapsed, F.lit(""))


@built_once
def gathered(tokens: Column | str) -> Column:
    """``struct<ldjson, meta, doc_title>`` from the tokens of a page."""
    tokens = _col(tokens)
    return F.struct(
        _ldjson(tokens).alias("ldjson"), _meta(tokens).alias("meta"), _doc_title(tokens).alias("doc_title")
    )


@built_once
def gather_page(html: Column | str) -> Column:
    """Raw metadata of a page; stage :func:`page_tokens` first in a hot path."""
    return gathered(page_tokens(html))


@built_once
def page_title(html: Column | str) -> Column:
    return _doc_title(page_tokens(html))


@built_once
def meta_content(meta: Column | str, key: str) -> Column:
    """Content of the first tag with that key."""
    return F.get(F.filter(meta, lambda m: m["key"] == key), F.lit(0))["content"]
