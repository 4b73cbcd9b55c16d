"""Any date string to an ISO 8601 string that keeps its own UTC offset.

Each supported layout is one regular expression that names the parts of a date. The layouts are
tried one after another on the same text: the one that fits rewrites it into ten fields behind a
mark, and the others then fail at the first character. The fields are checked and
assembled natively, so no date leaves the scanning task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import bind, trim_space

# English month and weekday names, and the names of UTC.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UTC_NAMES = ("utc", "gmt", "z")

_MONTH = "(?<m>" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else m for m in MONTHS) + r"|sept)\.?"
_WEEKDAY = "(?:(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in WEEKDAYS) + r")\.?,?\s*)?"
_DAY = r"(?<d>0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?"
_YEAR = r"(?<y>\d{4}|\d{2})"
_GAP = r"(?:[,.]?\s+|[-/.])"
_SEP = r"(?:t|,?\s+(?:at\s+)?)"
# An unknown zone name is read and dropped; it must not be a month or weekday.
_RESERVED = "(?!(?:" + "|".join([m[:3] for m in MONTHS] + [d[:3] for d in WEEKDAYS]) + r")\b)"
_NAME = rf"(?:z|utc|gmt|{_RESERVED}(?-i:[A-Z]{{3,5}}))"
_OFFSET = r"(?:[+-](?:(?:[01]\d|2[0-3])(?::?[0-5]\d)?|\d)(?!\d))"
_ZONE = rf"(?:{_NAME}\s+(?=[+-]))?(?<z>{_OFFSET}|{_NAME}{_OFFSET}?)?(?:\s\((?-i:[A-Z]{{3,5}})\))?"
_CLOCK = (
    r"(?=\d{1,2}(?::|\s*[ap]))(?<h>\d{1,2})(?::(?<n>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d+))?)?)?"
    r"\s*(?:(?<p>[ap])\.?m?\.?(?![a-z]))?"
)
_TIME = rf"(?:{_SEP}{_CLOCK}\s*{_ZONE})?"
_COMPACT_TIME = rf"(?:t?(?<h>\d{{2}})(?<n>\d{{2}})(?:(?<s>\d{{2}})(?:\.(?<f>\d+))?)?(?<p>)\s*{_ZONE})?"

#: Already in the form of the result, but for an offset of minus zero.
_CANONICAL = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d"
    r"(?!-00:00)(?:[+-](?:[01]\d|2[0-3]):[0-5]\d)?$"
)

_CUT = r"(?<c>[-/. ])"
#: Three numbers mean year first if the first cannot be a day, day first if it cannot be a month, else month first.
_LAYOUTS = (
    rf"{_WEEKDAY}(?<y>\d{{4}}){_CUT}(?<m>\d{{1,2}})\k<c>(?<d>\d{{1,2}}){_TIME}",
    rf"(?<y>\d{{4}})(?<m>\d{{2}})(?<d>\d{{2}}){_COMPACT_TIME}",
    rf"(?<y>\d{{4}})(?<m>\d{{2}})(?<d>\d{{2}}){_TIME}",
    rf"{_WEEKDAY}{_DAY}{_GAP}(?:of\s+)?{_MONTH}{_GAP}{_YEAR}{_TIME}",
    rf"{_WEEKDAY}{_MONTH}{_GAP}{_DAY}{_GAP}{_YEAR}{_TIME}",
    rf"(?<y>\d{{4}}|3[2-9]|[4-9]\d){_GAP}{_MONTH}{_GAP}{_DAY}{_TIME}",
    rf"{_WEEKDAY}(?<d>1[3-9]|2\d|3[01]){_CUT}(?<m>\d{{1,2}})\k<c>{_YEAR}{_TIME}",
    rf"{_WEEKDAY}(?<y>3[2-9]|[4-9]\d){_CUT}(?<m>\d{{1,2}})\k<c>(?<d>\d{{1,2}}){_TIME}",
    rf"{_WEEKDAY}(?<m>\d{{1,2}}){_CUT}(?<d>\d{{1,2}})\k<c>{_YEAR}{_TIME}",
)
_MARK = "\u0001"
_REWRITTEN = _MARK + "|".join(f"${{{name}}}" for name in "ymdhnsfpz")


def _unnamed(pattern: str) -> str:
    return re.sub(r"\(\?<\w>", "(?:", pattern)


#: Clock in front of the date, and clock between day and year: both are put behind.
#: A hyphen behind an abbreviated month would be the sign of an offset there.
_CLOCK_FIRST = rf"^(?i)({_unnamed(_CLOCK)}\s*{_unnamed(_ZONE)}),?\s+(?:on\s+)?(?!.*[a-z]\.-)(\S.*)$"
_YEAR_LAST = rf"^(?i){_WEEKDAY}({_unnamed(_MONTH)}\s+{_unnamed(_DAY)}),?\s+({_unnamed(_CLOCK)}\s*{_unnamed(_ZONE)})\s+(\d{{4}})$"


def _fields(text: Column) -> Column:
    """``[year, month, day, hour, minute, second, fraction, a/p, zone]`` or NULL."""
    text = F.regexp_replace(text, _CLOCK_FIRST, "$2 $1")
    text = F.regexp_replace(text, _YEAR_LAST, "$1 $3 $2")
    for pattern in _LAYOUTS:
        text = F.regexp_replace(text, f"^(?i){pattern}$", _REWRITTEN)
    return bind(text, lambda t: F.when(F.startswith(t, F.lit(_MARK)), F.split(F.substr(t, F.lit(2)), r"\|")))


def _assemble(f: Column) -> Column:
    def part(i: int) -> Column:
        return F.get(f, F.lit(i))

    def two(text: Column) -> Column:
        return F.lpad(text, 2, "0")

    # Two digits mean the year of that ending that is less than fifty years off.
    now = F.year(F.current_date())
    near = part(0).cast("int") + now - now % 100
    full = near + F.when(near >= now + 50, -100).when(near < now - 50, 100).otherwise(0)
    year = F.when(F.length(part(0)) == 2, F.lpad(full.cast("string"), 4, "0")).otherwise(part(0))
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    named = F.array_position(names, F.substring(F.lower(part(1)), 1, 3))
    month = F.when(named > 0, named.cast("string")).otherwise(part(1))
    day = F.concat_ws("-", year, two(month), two(part(2)))

    meridiem = F.lower(part(7))
    hour_in = F.when(part(3) == "", F.lit(0)).otherwise(part(3).cast("int"))
    hour = (
        F.when(meridiem == "", hour_in)
        .when(hour_in > 12, F.lit(None))
        .when(meridiem == "a", hour_in % 12)
        .otherwise(hour_in % 12 + 12)
    )
    minute = F.when(part(4) == "", F.lit(0)).otherwise(part(4).cast("int"))
    second = F.when(part(5) == "", F.lit(0)).otherwise(part(5).cast("int"))
    in_range = (hour <= 23) & (minute <= 59) & (second <= 59)

    micros = F.rpad(F.substring(part(6), 1, 6), 6, "0")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))

    zone = F.lower(part(8))
    found = F.regexp_replace(zone, "[^0-9]", "")
    digits = F.rpad(F.when(F.length(found) == 1, F.concat(F.lit("0"), found)).otherwise(found), 4, "0")
    # Behind a name the sign says how far UTC is from there.
    plus = F.contains(zone, F.lit("+")) != F.regexp_like(zone, F.lit("^[a-z]+[+-]"))
    signed = F.regexp_like(zone, F.lit("[+-]"))
    offset = (
        F.when(zone.isin(*UTC_NAMES) | signed & (digits == "0000"), F.lit("+00:00"))
        .when(
            signed,
            F.concat(F.when(plus, "+").otherwise("-"), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)),
        )
        .otherwise(F.lit(""))
    )
    clock = F.concat_ws(":", *[two(x.cast("string")) for x in (hour, minute, second)])
    valid = day.try_cast("date").isNotNull() & (part(0) != "0000") & in_range
    return F.when(f.isNotNull() & valid, F.concat(day, F.lit("T"), clock, fraction, offset))


@built_once
def to_iso8601(value: Column | str) -> Column:
    """ISO 8601 with the source offset, NULL if it is no complete date; the common layout is only checked."""

    def normal(text: Column) -> Column:
        is_day = F.substring(text, 1, 10).try_cast("date").isNotNull()
        checked = F.when(is_day, text)
        return F.when(F.regexp_like(text, F.lit(_CANONICAL)), checked).otherwise(bind(_fields(text), _assemble))

    return bind(trim_space(value), normal)
