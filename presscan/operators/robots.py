"""Robots exclusion rules as a table.

A file is read where it is scanned: its lines become one-letter tokens, and one
regular expression over the token text finds the groups. Nothing is shuffled
and no state is carried from row to row. A verdict needs one policy row per
origin, so joining it to the URLs never multiplies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.functions.reuse import built_once
from presscan.functions.text import _col, bind, trim_space
from presscan.functions.urls import percent_decode, url_origin
from presscan.schema import CRAWL_DELAY, KIND_ROBOTS, USER_AGENT
from presscan.sources.documents import first_per_key, usable_documents

_LINE_END = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

# The fields of a robots file that open a group or belong to one.
_FIELDS = {
    "user-agent": "U",
    "allow": "A",
    "disallow": "D",
    "crawl-delay": "C",
    "request-rate": "Q",
}
#: Agent lines directly followed by rule lines. Blank lines (``B``) end a group;
#: the repetitions are possessive, so long files cost no stack.
_GROUP = r"(?md)^(?:U[^\n]*+\n)++(?:[ADCQ][^\n]*+\n)++"


def _token(line: Column) -> Column:
    """``<letter><raw value>`` for a line that matters, ``B`` for an empty one."""

    def letter(field: Column) -> Column:
        short = F.lit(None).cast("string")
        for name, code in _FIELDS.items():
            short = F.when(field == name, F.lit(code)).otherwise(short)
        return short

    def coded(text: Column) -> Column:
        field = F.lower(trim_space(F.substring_index(text, ":", 1)))
        value = trim_space(F.regexp_replace(text, r"(?s)^[^:]*:", ""))
        return F.when(F.contains(text, F.lit(":")), F.concat(bind(field, letter), value))

    return F.when(line == "", F.lit("B")).otherwise(bind(trim_space(F.substring_index(line, "#", 1)), coded))


def _without_empty_parts(path: Column) -> Column:
    """Drop the ``;``, ``?`` and ``#`` of an empty part."""
    path = F.regexp_replace(path, r"(?s)^([^#]*)#$", "$1")
    path = F.regexp_replace(path, r"(?s)^([^?#]*)\?(?=#|$)", "$1")
    return F.regexp_replace(path, r"(?s)^((?:[^?#]*/)?[^?#;/]*);(?=[?#]|$)", "$1")


def _rule_path(value: Column) -> Column:
    return F.regexp_replace(_without_empty_parts(value), "^//(?=/(?!/))", "")


@built_once
def _target(url: Column | str) -> Column:
    """What rule paths are prefixes of: decoded path, query and fragment."""
    rest = F.regexp_replace(percent_decode(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")

    def rooted(path: Column) -> Column:
        return (
            F.when(path == "", F.lit("/"))
            .when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path))
            .otherwise(path)
        )

    return bind(_without_empty_parts(rest), rooted)


def _group(text: Column) -> Column:
    return bind(F.filter(F.split(text, "\n"), lambda l: l != ""), _group_of_lines)


def _group_of_lines(lines: Column) -> Column:
    def values(letters: str) -> Column:
        return F.filter(lines, lambda l: F.substring(l, 1, 1).isin(*letters))

    def value(line: Column) -> Column:
        return percent_decode(F.substring(line, F.lit(2), F.length(line)))

    agents = F.transform(values("U"), value)
    rules = F.transform(
        values("AD"),
        lambda l: F.struct(
            _rule_path(value(l)).alias("path"),
            (F.startswith(l, F.lit("A")) | (value(l) == "")).alias("allow"),
        ),
    )
    delays = F.filter(
        F.transform(values("C"), lambda l: trim_space(value(l))), lambda v: F.regexp_like(v, F.lit(r"^\d+$"))
    )
    return F.struct(
        agents.alias("agents"),
        F.array_contains(agents, "*").alias("is_default"),
        rules.alias("rules"),
        F.try_element_at(delays, F.lit(-1)).cast("double").alias("delay"),
    )


@built_once
def robots_groups(body: Column | str) -> Column:
    """Groups of a robots file, in file order."""
    tokens = F.filter(F.transform(F.split(_col(body), _LINE_END), _token), lambda t: t.isNotNull())
    text = F.concat(F.array_join(tokens, "\n"), F.lit("\n"))
    return F.transform(F.regexp_extract_all(text, F.lit(_GROUP), F.lit(0)), _group)


def robots_answers(documents: DataFrame) -> DataFrame:
    """What every origin asked for its robots file said: ``(origin, attempt, no_file, fetched_at, groups)``.

    A text resource is requested once, so the lowest attempt counts, and of its answers the
    first that holds a file; ``groups`` is NULL where none does.
    """
    asked = usable_documents(documents, KIND_ROBOTS).where(F.col("url") == F.concat(url_origin("url"), F.lit("/robots.txt")))
    answers = asked.select(
        url_origin("url").alias("origin"),
        "attempt",
        (F.coalesce("body", F.lit("")) == "").alias("no_file"),
        "fetched_at",
        F.when(F.col("body") != "", robots_groups("body")).alias("groups"),
    )
    return first_per_key(answers, ["origin"], [F.col(c) for c in ANSWER_ORDER])


#: Which of an origin's answers counts.
ANSWER_ORDER = ("attempt", "no_file", "fetched_at")


def robots_policies(documents: DataFrame) -> DataFrame:
    """``(origin, groups)``: the one robots file of every origin that has one."""
    return robots_answers(documents).where(~F.col("no_file")).select("origin", "groups")


def robots_rules(documents: DataFrame) -> DataFrame:
    """One row per rule line: origin, group, agents, rule order, path, allow."""
    groups = robots_policies(documents).select("origin", F.posexplode("groups").alias("group_ord", "g"))
    return groups.select(
        "origin",
        "group_ord",
        F.col("g.agents").alias("agents"),
        F.col("g.is_default").alias("is_default"),
        F.posexplode("g.rules").alias("rule_ord", "rule"),
    ).select("origin", "group_ord", "agents", "is_default", "rule_ord", "rule.path", "rule.allow")


def robots_delays(documents: DataFrame) -> DataFrame:
    """Advertised crawl delay per group, NULL where a group names none."""
    groups = robots_policies(documents).select("origin", F.posexplode("groups").alias("group_ord", "g"))
    return groups.select("origin", "group_ord", F.col("g.agents"), F.col("g.is_default"), F.col("g.delay"))


def agent_policy(policies: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """``(origin, rules, delay)`` of the one group that binds ``user_agent``."""
    return policies.select("origin", _binding_group(user_agent).alias("_g")).select(
        "origin", F.col("_g.rules").alias("rules"), F.col("_g.delay").alias("advertised")
    )


@built_once
def _binding_group(user_agent: str) -> Column:
    agent = F.lit(user_agent.split("/")[0].lower())
    named = F.filter(
        "groups", lambda g: ~g["is_default"] & F.exists(g["agents"], lambda a: F.contains(agent, F.lower(a)))
    )
    default = F.filter("groups", lambda g: g["is_default"])
    return F.coalesce(F.get(named, F.lit(0)), F.get(default, F.lit(0)))


@built_once
def _decision(rules: str, target: str) -> Column:
    return F.get(F.filter(rules, lambda r: F.startswith(F.col(target), r["path"])), F.lit(0))["allow"]


def robots_verdict(
    urls: DataFrame,
    policies: DataFrame,
    user_agent: str = USER_AGENT,
    default_delay: float = CRAWL_DELAY,
) -> DataFrame:
    """``urls`` with ``allowed`` and ``delay``.

    The first rule, in file order, whose path is a prefix decides; a URL with
    no rule, no group or no robots file is allowed.
    """
    policy = agent_policy(policies, user_agent)
    located = urls.select("*", url_origin("url").alias("origin"), _target("url").alias("_target"))
    return (
        located.join(policy, "origin", "left")
        .select(
            *urls.columns,
            F.coalesce(_decision("rules", "_target"), F.lit(True)).alias("allowed"),
            F.greatest(F.coalesce("advertised", F.lit(default_delay)), F.lit(default_delay)).alias("delay"),
        )
    )
