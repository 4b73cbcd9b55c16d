"""Accent-insensitive text functions, as native column expressions.

Compatibility decomposition (NFKD) followed by dropping combining marks works
character by character, so it splits into three native steps:

* characters with a one-character result, or none: one ``translate``;
* characters with a longer result (ligatures, fractions, the ellipsis ...): the
  few distinct ones of a text are found by one regular expression and replaced;
* Hangul syllables: decomposed arithmetically into their jamo.

All tables follow from :mod:`unicodedata` by rule.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3
_JAMO_LEAD, _JAMO_VOWEL, _JAMO_TAIL = 0x1100, 0x1161, 0x11A7
_VOWELS, _TAILS = 21, 28

#: Two ranges that hold every character with a longer result. They reject most
#: Latin text at little cost, before the many ranges of the exact class.
_BEYOND_LATIN = "[\\x{bc}-\\x{be}\\x{132}-\\x{10ffff}]"

#: Characters that count as white space (``str.isspace``).
SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def plain(text: str) -> str:
    """Driver-side twin of :func:`strip_accents`, for constant keywords."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


@cache
def _tables() -> tuple[str, str, str, list[str], str]:
    singles, targets, dropped, longer, expansions = [], [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        ch = chr(code)
        result = plain(ch)
        if result == ch:
            continue
        if not result:
            dropped.append(ch)
        elif len(result) == 1:
            singles.append(ch)
            targets.append(result)
        else:
            longer.append(ch)
            expansions.append(result)
    source = "".join(singles + dropped)
    return source, "".join(targets), "".join(longer), expansions, _char_class(longer)


def _ranges(chars: str | list[str], gap: int = 1) -> str:
    """Characters as ranges of a regular expression class.

    Gaps below ``gap`` are bridged; fewer ranges make the test cheaper.
    """
    codes = sorted(ord(c) for c in chars)
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _char_class(chars: list[str]) -> str:
    """Characters with a longer result; a bridged one maps to itself."""
    hangul = f"\\x{{{_HANGUL_FIRST:x}}}-\\x{{{_HANGUL_LAST:x}}}"
    return f"(?={_BEYOND_LATIN})[{_ranges(chars, gap=16)}{hangul}]"


def bind(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst copies an expression to every place that uses it; nested, the
    copies multiply. A column name is passed through: it costs nothing twice.
    """
    if isinstance(value, str):
        return body(F.col(value))
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _jamo(syllable: Column) -> Column:
    """The two or three jamo of a Hangul syllable."""
    index = F.ascii(syllable) - F.lit(_HANGUL_FIRST)

    def pick(first: int, count: int, at: Column) -> Column:
        letters = F.lit("".join(chr(first + i) for i in range(count)))
        return F.substring(letters, at.cast("int") + 1, F.lit(1))

    tail = F.pmod(index, F.lit(_TAILS))
    return F.concat(
        pick(_JAMO_LEAD, 19, F.floor(index / (_VOWELS * _TAILS))),
        pick(_JAMO_VOWEL, _VOWELS, F.floor(F.pmod(index, F.lit(_VOWELS * _TAILS)) / _TAILS)),
        F.when(tail > 0, pick(_JAMO_TAIL, _TAILS, tail)).otherwise(F.lit("")),
    )


def _expand(text: Column) -> Column:
    _, _, longer, expansions, char_class = _tables()
    keys = F.lit(longer)
    values = F.split(F.lit("\n".join(expansions)), "\n")

    def decomposed(ch: Column) -> Column:
        at = F.instr(keys, ch)
        is_hangul = ch.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST))
        return F.when(at > 0, F.get(values, at - 1)).when(is_hangul, _jamo(ch)).otherwise(ch)

    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({char_class})"), F.lit(0)))
    replaced = F.aggregate(hits, text, lambda acc, ch: F.replace(acc, ch, decomposed(ch)))
    return F.when(F.regexp_like(text, F.lit(_BEYOND_LATIN)), replaced).otherwise(text)


@built_once
def strip_accents(text: Column | str) -> Column:
    """NFKD without combining marks; pure ASCII text is passed through as is."""
    source, target, *_ = _tables()

    def stripped(t: Column) -> Column:
        is_ascii = F.octet_length(t) == F.char_length(t)
        return F.when(is_ascii, t).otherwise(bind(F.translate(t, source, target), _expand))

    return bind(text, stripped)


@built_once
def fold(text: Column | str) -> Column:
    """Accents stripped and lower-cased, white space untouched."""
    return F.lower(strip_accents(text))


def trim_space(text: Column | str, chars: str = SPACES) -> Column:
    """Trim every Unicode white-space character, not only the space."""
    return F.trim(_col(text), F.lit(chars))


@built_once
def normalize_text(text: Column | str) -> Column:
    """Strip accents, lower-case, collapse white space, trim; NULL gives ``''``."""
    # Visible ASCII is rejected by one range, before the many of white space.
    others, spaces = _ranges(SPACES.replace(" ", "")), _ranges(SPACES)
    runs = f"(?![!-~])(?:[{others}][{spaces}]*+| [{spaces}]++)"
    return F.coalesce(F.trim(F.regexp_replace(fold(text), runs, " ")), F.lit(""))


@built_once
def keyword_tokens(keyword: Column | str) -> Column:
    """Tokens of a keyword column."""
    return F.filter(F.split(normalize_text(keyword), " "), lambda t: t != "")


def constant_tokens(keyword: str) -> list[str]:
    """Tokens of a keyword known to the driver."""
    return plain(keyword).lower().split()


@built_once
def haystack(*texts: Column | str) -> Column:
    """The folded text the tokens are looked up in.

    Tokens hold no white space, so joining before folding and leaving runs of
    white space alone changes no match.
    """
    return fold(F.concat_ws(" ", *[_col(t) for t in texts]))


def contains_tokens(text: Column, tokens: list[str]) -> Column:
    """Every token is a substring of ``text``; no tokens never match."""
    if not tokens:
        return F.lit(False)

    def all_in(t: Column) -> Column:
        hit = F.contains(t, F.lit(tokens[0]))
        for token in tokens[1:]:
            hit = hit & F.contains(t, F.lit(token))
        return hit

    return F.coalesce(F.exists(F.array(text), all_in), F.lit(False))


def contains_token_column(text: Column, tokens: Column) -> Column:
    """The same with tokens that differ from row to row."""
    return F.exists(
        F.array(F.struct(text.alias("text"), tokens.alias("tokens"))),
        lambda row: (F.size(row["tokens"]) > 0) & F.forall(row["tokens"], lambda t: F.contains(row["text"], t)),
    )


def keyword_matches(keyword: str | Column, *texts: Column | str) -> Column:
    """True where every token of ``keyword`` occurs somewhere in ``texts``.

    A ``str`` keyword is folded once on the driver and becomes a conjunction of
    ``contains``; a ``Column`` keyword is tokenised per row.
    """
    text = haystack(*texts)
    if isinstance(keyword, str):
        return contains_tokens(text, constant_tokens(keyword))
    return contains_token_column(text, keyword_tokens(keyword))


def first_nonblank(*values: Column | str) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[nonblank(v) for v in values])


@built_once
def nonblank(value: Column | str) -> Column:
    """Trimmed text, NULL if nothing is left."""
    return bind(trim_space(value), lambda t: F.nullif(t, F.lit("")))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
