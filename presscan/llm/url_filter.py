"""URL verdicts by host and path rules, and beyond them by a tree of path templates.

Paths of a host form a tree of segments. Going down level by level, segments that vary become
wildcards: those that look like an identifier at once, on the scanning task, and under a
node of very many children all those of a small share. Siblings that look alike
statistically become one branch: neighbours in the order of their share of bad
pages are merged, the most alike first, while a chi-square test on label and remaining
depth sees no difference. A node has a bounded number of branches then, and what is left
of a path is its template.

Pages that a rule decides are the labelled ones. A template is rejected if its share of bad
ones among them, smoothed by a few imagined good ones, is high. A template without labelled
pages is allowed: nothing speaks against it.

Pages are counted by host and shape of the path first; the tree is grown from counts, so a host with
most of the pages is a few rows. Only the keys of rejected templates meet the pages again,
and the most frequent of them, of which there are few, are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.session import stored


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


#: Segments a template tells apart; what follows is one segment.
DEPTH = 8
#: A node of more children than this keeps those with at least a 1/SHARE of its pages by name.
WIDE, SHARE = 32, 64
#: Bad and good pages that every template is imagined to have, and the share of bad ones that rejects it.
IMAGINED_BAD, IMAGINED_GOOD, REJECTED = 1, 4, 0.5
#: Keys with more than this part of the pages are broadcast, so there are at most as many.
HOT = 1024
_LONG = 24
_REMAINING = 4
_STATES = ("bad", "good", "none")
_TAIL = "**"
_CELLS = [f"c{i}" for i in range(_REMAINING * len(_STATES))]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; then up to ``?`` or ``#``."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def deciding_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path of the longest rule that fits, and its verdict; nulls without one.

    Of rules of one length that of the longer host decides, and of equal ones the first.
    """
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host))):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, rule.host + rule.path) if name is None else name.when(fits, rule.host + rule.path)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def shape(path: Column) -> Column:
    """The path's segments with those that look like identifiers as wildcards, which keep an extension."""
    extension = r"\.[A-Za-z]{1,5}$"

    def general(segment: Column) -> Column:
        varies = segment.rlike(r"[0-9%*()|]") | (F.length(segment) > _LONG)
        return F.when(varies, F.concat(F.lit("*"), F.lower(F.regexp_extract(segment, extension, 0)))).otherwise(segment)

    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)
    cut = F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit(_TAIL)))
    return F.array_join(F.when(F.size(segments) > DEPTH, cut).otherwise(segments), "/")


def _critical(freedom: int) -> float:
    """What a chi-square statistic exceeds in one of twenty cases (Wilson and Hilferty's cube)."""
    part = 2 / (9 * freedom)
    return freedom * (1 - part + 1.6449 * part**0.5) ** 3


def _unlike(a: np.ndarray, b: np.ndarray) -> float:
    """Chi-square statistic of two rows of counts over its critical value; above 1, they differ."""
    table = np.stack([a, b])[:, (a + b) > 0]
    if table.shape[1] < 2:
        return 0.0
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    return float(((table - expected) ** 2 / expected).sum()) / _critical(table.shape[1] - 1)


def merged_names(names: Sequence[str], counts: np.ndarray) -> list[str]:
    """The name of each sibling's branch after similar ones are merged; ``counts`` by remaining depth and label."""
    by_state = counts.reshape(len(names), _REMAINING, len(_STATES)).sum(1)
    shares = by_state / by_state.sum(1, keepdims=True)
    order = sorted(range(len(names)), key=lambda i: (shares[i, 0], shares[i, 2], names[i]))
    branches = [([names[i]], counts[i].astype(float)) for i in order]
    gaps = [_unlike(a[1], b[1]) for a, b in zip(branches, branches[1:], strict=False)]
    while gaps and min(gaps) <= 1:
        i = gaps.index(min(gaps))
        branches[i : i + 2] = [(branches[i][0] + branches[i + 1][0], branches[i][1] + branches[i + 1][1])]
        del gaps[i]
        for j in (i - 1, i):
            if 0 <= j < len(gaps):
                gaps[j] = _unlike(branches[j][1], branches[j + 1][1])
    found = {}
    for members, _ in branches:
        found |= dict.fromkeys(members, members[0] if len(members) == 1 else f"({'|'.join(sorted(members))})")
    return [found[n] for n in names]


def _level(leaves: DataFrame, depth: int) -> DataFrame:
    """``leaves`` with one more segment in the templates of those that have one at ``depth``."""
    segments = F.split("shape", "/")
    live = leaves.filter(F.col("size") > depth).withColumn("segment", segments[depth])
    remaining = F.least(F.col("size") - depth - 1, F.lit(_REMAINING - 1))
    cells = [F.sum(F.when(remaining == r, F.col(s)).otherwise(0)) for r in range(_REMAINING) for s in _STATES]
    key = ["host", "template"]
    nodes = stored(live.groupBy(*key, "segment").agg(F.sum("n").alias("n"), *[c.alias(name) for c, name in zip(cells, _CELLS, strict=True)]))
    # Children of a wide node that few pages have are one wildcard.
    wide = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all")).filter(F.col("children") > WIDE)
    named = nodes.join(wide, key, "left").withColumn("branch", F.when(F.col("n") * SHARE < F.col("all"), "*").otherwise(F.col("segment")))
    named = stored(named.select(*key, "segment", "branch", "n", *_CELLS))
    siblings = named.groupBy(*key, "branch").agg(*[F.sum(c).alias(c) for c in _CELLS])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out = group[[*key, "branch"]].copy()
        out["merged"] = merged_names(group["branch"].tolist(), group[_CELLS].to_numpy())
        return out

    # At most max(WIDE, SHARE) + 1 siblings a group, whatever the host's size.
    merged = siblings.groupBy(*key).applyInPandas(merge, "host string, template string, branch string, merged string")
    renamed = named.join(merged, [*key, "branch"]).select(*key, "segment", "merged")
    grown = live.join(renamed, [*key, "segment"]).withColumn("template", F.concat_ws("/", "template", "merged"))
    return stored(grown.select(*leaves.columns).unionByName(leaves.filter(F.col("size") <= depth)))


def _decided(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = deciding_rule(rules, F.col("host"), F.col("path"))
    return rows.select("*", rule.alias("rule"), verdict.alias("decided"), shape(F.col("path")).alias("shape"))


def _grown(decided: DataFrame) -> DataFrame:
    """host, shape and template with the number of pages n, and of them bad, good and none (unlabelled)."""
    states = {"bad": F.col("decided") == "block", "good": F.col("decided") == "allow", "none": F.col("decided").isNull()}
    sums = [F.count(F.when(s, True)).alias(k) for k, s in states.items()]
    leaves = decided.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), *sums)
    size = F.when(F.col("shape") == "", 0).otherwise(F.size(F.split("shape", "/")))
    leaves = stored(leaves.withColumn("size", size).withColumn("template", F.lit("")))
    for depth in range(leaves.agg(F.max("size")).first()[0] or 0):
        leaves = _level(leaves, depth)
    return leaves


def _purity() -> Column:
    return (F.col("bad") + IMAGINED_BAD) / (F.col("bad") + F.col("good") + IMAGINED_BAD + IMAGINED_GOOD)


def templates(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """host, template, its pages n, bad and good ones among them, smoothed purity (share of bad) and rejected."""
    return _judged(_grown(_decided(pages, rules)))


def _judged(leaves: DataFrame) -> DataFrame:
    found = leaves.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    return found.withColumn("purity", _purity()).withColumn("rejected", F.col("purity") >= REJECTED)


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rule`` is host and path of the rule that decides, null if none fits; then the verdict is
    block if the page's template is rejected, else allow. A null url and one without ``://``
    have an empty host and path. Rows that repeat a page or its id are judged alike and stay
    rows. A table without rows gives none. ``rules`` are a constant of the plan.
    """
    decided = _decided(pages, rules)
    leaves = _grown(decided)
    bad = _judged(leaves).filter("rejected").select("host", "template")
    keys = stored(leaves.join(bad, ["host", "template"]).select("host", "shape", "n", F.lit("block").alias("found")))
    total = leaves.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total  # fewer than HOT keys
    rows = decided.join(F.broadcast(keys.filter(hot).drop("n")), ["host", "shape"], "left").withColumnRenamed("found", "often")
    # Pages that a rule or a frequent key decides need no other: their keys stay out of the join.
    undecided = F.col("decided").isNull() & F.col("often").isNull()
    settled = rows.filter(~undecided).withColumn("found", F.lit(None).cast("string"))
    rest = rows.filter(undecided).join(keys.filter(~hot).drop("n"), ["host", "shape"], "left")
    verdict = F.coalesce("decided", "often", "found", F.lit("allow")).alias("verdict")
    return settled.unionByName(rest).select("page_id", "host", "path", "rule", verdict)
