"""Resampling, URL verdicts and filter interaction against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest

from presscan.llm import interaction, resample, url_filter
from presscan.llm.url_filter import Rule
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def drawn_by_hand(rows, target, percent, least):
    def features(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [crc32(w.encode()) % 10000 for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)]

    raw, wanted = Counter(b for _, t in rows for b in features(t)), Counter(b for t in target for b in features(t))
    all_raw, all_wanted = sum(raw.values()) + 10000, sum(wanted.values()) + 10000
    scored = []
    for doc, text in rows:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * all_raw / ((raw[b] + 1) * all_wanted))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc, len(found), weight, score))
    order = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    size = percent * len(order) // 100
    left = [r for r in scored if r[1] < least] + order[size:]
    return sorted(map(repr, [(*r, i) for i, r in enumerate(order[:size], 1)] + [(*r, None) for r in left]))


@pytest.mark.parametrize(("percent", "least"), [(10, 20), (35, 20), (100, 0), (0, 0), (60, 1)])
def test_resample(make_docs, mixed_rows, spark, percent, least):
    rng = random.Random(1)
    rows = [r[:2] for r in mixed_rows] + [(None, words(rng, 30)), (None, words(rng, 30)), (12, "again " * 25), (None, None)]
    target = [words(rng, 40), None, "", "ABC éé 12-x"]
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, score string")
    found = resample.resample(make_docs(rows), wanted, percent, least)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == drawn_by_hand(rows, target, percent, least)


@pytest.mark.parametrize("percent", [3, 50, 97])
def test_resample_cuts_through_ties(make_docs, spark, percent):
    """Rows alike in score and id, of one id and without one, are cut in their midst."""
    text = "one two three"
    rows = [(7, text)] * 150 + [(None, text)] * 120 + [(i, text) for i in range(8, 30)]
    nothing = spark.createDataFrame([], "text string")
    found = [tuple(r) for r in resample.resample(make_docs(rows), nothing, percent, 1).collect()]
    assert sorted(map(repr, found)) == drawn_by_hand(rows, [], percent, 1)


def test_bisection_finds_every_threshold(spark):
    values = [-(1 << 62), -5, -5, -5, 0, 3, 3, 900, 1 << 62]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in range(1, len(values) + 1):
        assert resample._largest(rows, rows["v"], wanted) == sorted(values, reverse=True)[wanted - 1]


def test_resample_of_nothing(make_docs, spark):
    nothing = spark.createDataFrame([], "text string")
    assert resample.resample(make_docs([(1, "x")]).filter("doc_id > 1"), nothing).count() == 0


def audited_by_hand(rows, labels):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts: dict = {}
    for doc, text, _, source in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and text in first and doc > first[text],
        }
        parts.setdefault(source or "", []).append((doc, {k for k, v in fails.items() if v}))
    out = []
    for part, docs in parts.items():
        shares, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[f] += len(gone)
                failing = sum(f in d[1] for d in docs)
                lone = sum(d[1] == {f} for d in docs)
                found.append((f, part, "".join(order), step, len(left), len(gone), failing - len(gone), lone, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*r[1:], shares[r[0]]) for r in found]
    return sorted(map(repr, out))


def test_interaction(make_docs, mixed_rows, spark):
    rng = random.Random(3)
    rows = [(*r, "en", "a")[:4] if len(r) < 4 else r for r in mixed_rows]
    rows += [(50, words(rng, 300), "en", "b"), (51, "A# " * 300, None, ""), (None, words(rng, 300), "en", None), (None, "one", "en", "z"), (4, "one", "en", "z")]
    rows += [(50, rows[-5][1], "en", "b"), (52, rows[-5][1], "en", "b"), (60, "Word" + " word" * 400, "fr", "c"), (4, "other", "en", "a")]
    labels = [(i, i % 3 % 2, i % 4 == 1) for i in range(0, 60, 2)] + [(4, 1, False), (4, 0, True), (None, 1, True), (30, None, None), (999, 1, True)]
    marked = spark.createDataFrame([(d, q, None if t is None else int(t), "x") for d, q, t in labels], "doc_id long, quality int, toxic int, part string")
    found = interaction.audit(make_docs(rows), marked)
    assert sorted(repr(tuple(r)) for r in found.collect()) == audited_by_hand(rows, labels)


def test_interaction_without_labels_or_documents(make_docs, spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None, "en", None)]
    assert sorted(repr(tuple(r)) for r in interaction.audit(make_docs(rows), nothing).collect()) == audited_by_hand(rows, [])
    assert interaction.audit(make_docs(rows).filter("doc_id > 1"), nothing).count() == 0


RULES = [Rule("allow", "com", "/"), Rule("block", "ex.com", "/en/"), Rule("allow", "www.ex.com", "/en/"), Rule("block", "net", "/p/a")]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://WWW.Ex.com/en/1?x=/y#z", "www.ex.com", "/en/1", "www.ex.com/en/"),
        ("http://a.ex.com/en/1#top?x", "a.ex.com", "/en/1", "ex.com/en/"),
        ("http://ex.com/EN/1", "ex.com", "/EN/1", "com/"),
        ("http://ex.com/en", "ex.com", "/en", "com/"),
        ("http://ex.com?en/", "ex.com", "", None),
        ("http://notex.com/en/", "notex.com", "/en/", "com/"),
        ("http://telecom/", "telecom", "/", None),
        ("x://É.NET/p/abc\nd://e", "É.net", "/p/abc\nd://e", "net/p/a"),
        ("://", "", "", None),
        ("no scheme.com/en/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, host string")
    row = url_filter.judge(pages, RULES).first()
    verdict = next((r.verdict for r in RULES if r.host + r.path == rule), "allow")
    assert tuple(row) == (1, host, path, rule, verdict)


def grown_by_hand(leaves):
    """Template of every (host, segments), from {(host, segments): [bad, good, none]}."""
    found = {}

    def grow(host, template, members, depth):
        nodes: dict = {}
        for segments, counts in members.items():
            if len(segments) <= depth:
                found[host, segments] = template
            else:
                nodes.setdefault(segments[depth], {})[segments] = counts
        sizes = {s: sum(map(sum, of.values())) for s, of in nodes.items()}
        names = {s: "*" if len(nodes) > 32 and sizes[s] * 64 < sum(sizes.values()) else s for s in nodes}
        cells = {n: np.zeros((4, 3)) for n in names.values()}
        for s, of in nodes.items():
            for segments, counts in of.items():
                cells[names[s]][min(len(segments) - depth - 1, 3)] += counts
        order = sorted(cells, key=lambda n: (cells[n][:, 0].sum() / cells[n].sum(), cells[n][:, 2].sum() / cells[n].sum(), n))
        branches = [([n], cells[n].ravel()) for n in order]
        while len(branches) > 1:
            gaps = []
            for (_, a), (_, b) in zip(branches, branches[1:], strict=False):
                some = (a + b) > 0
                free = some.sum() - 1
                chi = sum((o[i] - o.sum() * (a + b)[i] / (a + b).sum()) ** 2 / (o.sum() * (a + b)[i] / (a + b).sum()) for o in (a, b) for i in np.flatnonzero(some))
                gaps.append(chi / (free * (1 - 2 / 9 / free + 1.6449 * (2 / 9 / free) ** 0.5) ** 3) if free else 0)
            i = int(np.argmin(gaps))
            if gaps[i] > 1:
                break
            branches[i : i + 2] = [(branches[i][0] + branches[i + 1][0], branches[i][1] + branches[i + 1][1])]
        for members_of, _ in branches:
            name = members_of[0] if len(members_of) == 1 else f"({'|'.join(sorted(members_of))})"
            grow(host, f"{template}/{name}", {g: c for s, of in nodes.items() if names[s] in members_of for g, c in of.items()}, depth + 1)

    for host in {h for h, _ in leaves}:
        grow(host, "", {s: c for (h, s), c in leaves.items() if h == host}, 0)
    return found


def judged_by_hand(rows):
    def decided(host, path):
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path), default=None)

    def shaped(path):
        out = []
        for s in filter(None, path.split("/")):
            end = re.search(r"\.[A-Za-z]{1,5}\Z", s)
            out.append("*" + (end[0].lower() if end else "") if re.search(r"[0-9%*()|]", s) or len(s) > 24 else s)
        return tuple(out if len(out) <= 8 else [*out[:8], "**"])

    pages, leaves = [], {}
    for page, url in rows:
        match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (match[1].lower(), match[2]) if match else ("", "")
        rule = decided(host, path)
        pages.append((page, host, path, rule))
        state = 2 if rule is None else int(rule.verdict == "allow")
        leaves.setdefault((host, shaped(path)), [0, 0, 0])[state] += 1
    template = grown_by_hand(leaves)
    totals: dict = {}
    for (host, segments), counts in leaves.items():
        totals.setdefault((host, template[host, segments]), np.zeros(3)).__iadd__(counts)
    out, by_method = [], 0
    for page, host, path, rule in pages:
        bad, good, _ = totals[host, template[host, shaped(path)]]
        reject = (bad + 1) / (bad + good + 5) >= 0.5
        by_method += rule is None and reject
        verdict = rule.verdict if rule else "block" if reject else "allow"
        out.append((page, host, path, rule.host + rule.path if rule else None, verdict))
    return sorted(map(repr, out)), by_method, {(h, t) for h, t in totals}


@pytest.fixture(scope="module")
def urls():
    """A large host with slugs under a partly blocked node, small hosts, deep paths, odd rows."""
    rng = random.Random(5)
    rows = [(i, f"http://big.net/{rng.choice(['p', 'q', 'news'])}/{rng.choice(words(rng, 3).split())}/{rng.choice(['x', 'y', '77.HTML'])}") for i in range(1500)]
    rows += [(i, f"http://big.net/p/{rng.choice(['a', 'a', 'a', 'b'])}{''.join(rng.choices('cdefgh', k=6))}") for i in range(1500, 2300)]
    rows += [(i, f"http://s{i % 7}.ex.com/{rng.choice(['en', 'de', 'fr', 'es', 'it'])}/{i}") for i in range(2300, 2500)]
    rows += [(i, f"https://t{i % 5}.org/{'/'.join(rng.choices('abc', k=rng.randint(0, 12)))}") for i in range(2500, 2700)]
    return rows + [(2700, None), (2700, None), (None, "http://big.net/p/azz"), (2701, ""), (2702, "http://big.net"), (2702, "http://big.net/p/b")]


@pytest.mark.parametrize("hot", [1024, 2, 1 << 40])
def test_urls(spark, urls, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)
    pages = spark.createDataFrame([(p, u, "x", "y", 1) for p, u in urls], "page_id long, url string, host string, verdict string, n int").repartition(3)
    expected, by_method, found = judged_by_hand(urls)
    assert by_method > 20
    assert sorted(repr(tuple(r)) for r in url_filter.judge(pages, RULES).collect()) == expected
    assert {(r["host"], r["template"]) for r in url_filter.templates(pages, RULES).collect()} == found


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, RULES).count() == 0
    assert [r["verdict"] for r in url_filter.judge(spark.createDataFrame([(1, "http://x.net/p/a")], "page_id long, url string"), []).collect()] == ["allow"]
