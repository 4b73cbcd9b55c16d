"""Operators on documents against plain Python, on rows with nulls, copies and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from presscan.llm import bpe, components, jaccard, language_id, licenses, mixing, quality, repeats, sharding, shingles
from presscan.session import stored
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(make_docs, mixed_rows):
    return make_docs(mixed_rows)


@pytest.fixture(scope="module")
def no_docs(make_docs):
    return make_docs([(1, "x")]).filter("doc_id > 1")


def test_quality_counts(docs, mixed_rows):
    found = by_id(quality.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc_id, text, *_ in mixed_rows:
        w = WORD.findall(text or "")
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert found[doc_id] == (*expected, len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_drops_junk_and_keeps_clean(make_docs, mixed_rows):
    clean = [r for r in mixed_rows if 9 < r[0] < 47]
    junk = [(i, " ".join(w + "###" for w in mixed_rows[30][1].split())) for i in range(100, 110)]
    kept = by_id(quality.judge(make_docs([*clean, *junk])), "kept", "posterior")
    assert all(kept[r[0]][0] for r in clean)
    assert not any(kept[r[0]][0] for r in junk)


def test_expectation_maximisation_by_hand(spark):
    """The model after its steps over vote patterns, and the posterior of a pattern."""
    rng = random.Random(14)
    rows = []
    for _ in range(400):
        good = rng.random() < 0.8
        rows.append([rng.choice((1, 1, 1, 0, -1)) if good else rng.choice((1, 0, -1, -1)) for _ in range(8)])
    model = quality.fit(spark.createDataFrame([(r,) for r in rows], "votes array<int>"))
    patterns = collections.Counter(map(tuple, rows))
    prior, rates = quality.START[0], [(quality.START[1], quality.START[2])] * 8
    for _ in range(quality.ITERATIONS):
        share = {}
        for p in patterns:
            odds = np.log(prior / (1 - prior))
            for v, (s, t) in zip(p, rates, strict=True):
                odds += np.log(s / (1 - t)) if v == 1 else np.log((1 - s) / t) if v == -1 else 0
            share[p] = 1 / (1 + np.exp(-odds))
        prior = min(max(sum(n * share[p] for p, n in patterns.items()) / len(rows), quality.PRIOR[0]), quality.PRIOR[1])
        rates = []
        for j in range(8):
            voted = [(n, share[p], p[j]) for p, n in patterns.items() if p[j]]
            s = sum(n * q for n, q, v in voted if v == 1) / sum(n * q for n, q, _ in voted)
            t = sum(n * (1 - q) for n, q, v in voted if v == -1) / sum(n * (1 - q) for n, q, _ in voted)
            s, t = min(max(s, quality.PASSES_GOOD[0]), quality.PASSES_GOOD[1]), min(max(t, quality.CATCHES_BAD[0]), quality.CATCHES_BAD[1])
            rates.append((s, max(t, 1.001 - s)))
    assert (model.prior, *model.on_good, *model.on_bad) == pytest.approx((prior, *(s for s, _ in rates), *(t for _, t in rates)), rel=1e-6)


def test_sharding(docs, mixed_rows):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(mixed_rows)
    texts = {r[0]: (r[1] or "").encode() for r in mixed_rows}
    slots = collections.defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] in (45, 46, 13)}) == 1


def test_shards_are_even_with_a_heavy_group_of_copies(make_docs):
    rows = make_docs([(i, "same text " * 9) for i in range(300)] + [(i, f"text {i} " * (i % 13 + 5)) for i in range(300, 900)])
    found = sharding.shard_documents(rows, 10)
    sizes = [r["b"] for r in found.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10
    assert max(sizes) < 1.1 * min(sizes)


def test_equal_texts_share_a_shard_unless_they_exceed_it(make_docs):
    """Groups of up to a shard stay whole, shards stay even; rows without an id or of one id are dealt out too."""
    rows = [(i, f"group {i % 7} " * 40) for i in range(280)] + [(i, f"own {i} " * (i % 11 + 20)) for i in range(280, 1200)]
    rows += [(None, "heavy " * 50)] * 400 + [(3, "heavy again " * 25)] * 300 + [(None, None), (5, ""), (5, None)]
    found = sharding.shard_documents(make_docs(rows), 10).collect()
    assert len(found) == len(rows)
    sizes, places = collections.Counter(), collections.defaultdict(set)
    for r in found:
        sizes[r["shard"]] += r["size"]
        places[r["text_crc32"]].add(r["shard"])
    assert set(sizes) == set(range(10)) and max(sizes.values()) < 1.1 * min(sizes.values())
    totals = collections.Counter(t or "" for _, t in rows)
    for text, n in totals.items():
        if n * (len(text) + 16) <= sum(sizes.values()) / 10:
            assert len(places[zlib.crc32(text.encode())]) == 1
    for shard in range(10):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))


def test_tree_by_hand(spark):
    """Every split is at the weighted median of the node's widest dimension."""
    rng = random.Random(6)
    points = [(rng.randrange(1 << 32), rng.randrange(17, 900), rng.randrange(1, 900), 0, rng.randrange(17, 900)) for _ in range(400)]
    columns = ["text_crc32", "size", "n_points", "piece", "weight"]
    df = spark.createDataFrame(points, "text_crc32 long, size long, n_points long, piece long, weight long").repartition(5)
    room = [1.0, 0.5, 1.0, 0.0, 2.0, 1.0]
    got = {tuple(r[c] for c in columns[:4]): r["shard"] for r in sharding.kd_shards(df, room).collect()}
    rows = [dict(zip(columns, p, strict=True)) for p in points]
    whole = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in sharding.DIMENSIONS}
    want = {}

    def split(some, first, k):
        if k == 1:
            want.update({tuple(r[c] for c in columns[:4]): first for r in some})
            return
        widest = max(sharding.DIMENSIONS, key=lambda d: (max(r[d] for r in some) - min(r[d] for r in some)) / whole[d])
        some = sorted(some, key=lambda r: (r[widest], r["text_crc32"], r["size"], r["n_points"]))
        share = sum(room[first : first + k // 2]) / sum(room[first : first + k])
        middle, before, left = sum(r["weight"] for r in some) * share, 0, []
        for r in some:
            if before + r["weight"] / 2 < middle:
                left.append(r)
            before += r["weight"]
        split(left, first, k // 2)
        split(some[len(left) :], first + k // 2, k - k // 2)

    split(rows, 0, len(room))
    assert got == want


def test_mix_reaches_targets(docs, mixed_rows):
    rows = mixing.mix(docs, block=8, fan_in=2).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7), block=8, fan_in=2).collect())
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in mixed_rows}
    order = sorted({r[3] for r in mixed_rows}, key=lambda s: (s is None, s))
    total = {s: sum(sizes[r[0]] for r in mixed_rows if r[3] == s) for s in order}
    targets, free, left = {}, dict(zip(order, (5, 2, 1, 5), strict=True)), 1.5 * sum(total.values())
    while True:
        unit = left / sum(free.values()) if free else 0
        above = [s for s in free if free[s] * unit > 2 * total[s]]
        if not above:
            break
        for s in above:
            targets[s] = 2.0 * total[s]
            left -= targets[s]
            del free[s]
    targets |= {s: w * unit for s, w in free.items()}
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= max([sizes[r[0]] for r in mixed_rows if r[3] == s]) for s in order)


def test_mix_without_ids_or_words(make_docs):
    rows = mixing.mix(make_docs([(None, "a b c"), (None, "a b c"), (1, None), (1, "")])).collect()
    assert len(rows) == 4 and sum(r["doc_id"] is None for r in rows) == 2


def test_mix_sources_keeps_rows_without_ids_and_repeated_ids_apart(make_docs, spark):
    rows = [(None, f"n{i} a b", "en", "s") for i in range(40)] + [(7, f"r{i} a b", "en", "s") for i in range(40)]
    rows += [(None, "same same same", "en", "s")] * 10 + [(i, f"u{i} a b", "en", "t") for i in range(100, 110)]
    docs = make_docs(rows)
    drawn = mixing.mix(docs).collect()
    assert len(drawn) == len(rows)
    out = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert set(out) <= set(rows[i][:2] + rows[i][3:] for i in range(len(rows)))
    assert all(n <= 2 for (_, text, _), n in out.items() if text != "same same same")
    assert {i is None for i, _, s in out if s == "s"} == {True, False}
    for source in "st":
        taken = sum(3 * n for (_, _, s), n in out.items() if s == source)
        assert abs(taken - next(r["target"] for r in drawn if r["source"] == source)) <= 3


def test_mix_deals_out_rows_without_ids(make_docs, monkeypatch):
    most, docs = [], make_docs([(None, f"a b {i % 100}") for i in range(400)])
    whole = type(docs).groupBy

    def grouped(frame, *columns):
        if columns == ("source_rank", "block"):
            most.append(whole(frame, *columns).count().agg({"count": "max"}).first()[0])
        return whole(frame, *columns)

    monkeypatch.setattr(type(docs), "groupBy", grouped)
    mixing.mix(docs, block=20).collect()
    assert 20 <= most[0] < 60


def brute_groups(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    linked = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    for _ in sets:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i]) for i in sets}


def test_jaccard_groups(docs, mixed_rows):
    assert by_id(jaccard.join_groups(docs), "n_shingles", "component_id") == brute_groups(mixed_rows)


def test_jaccard_at_the_threshold(make_docs):
    """Chains in which neighbours just link or just do not, so a key's members need comparing beyond its head."""
    base = [f"w{i}" for i in range(64)]
    rows = [(i, " ".join([*[f"x{j}" for j in range(i)], *base[i:]])) for i in range(0, 60, 2)]
    rows += [(100 + i, " ".join([*base[: 50 - i], *[f"y{i}{j}" for j in range(14)]])) for i in range(12)]
    assert by_id(jaccard.join_groups(make_docs(rows)), "n_shingles", "component_id") == brute_groups(rows)


@pytest.fixture
def in_slices(spark):
    """Documents of (doc_id, text) in one partition that tasks look at two by two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jaccard_head_of_a_key_meets_members_of_other_slices(in_slices, mixed_rows):
    rows = [(1, "a b c d e f g h"), (2, "z"), (5001, "x a b c d e f g"), (5002, "a b c d e f g")]
    rows += [(i + 10_000, text) for i, text, *_ in mixed_rows if i < 47]
    found = by_id(jaccard.join_groups(in_slices(rows)), "n_shingles", "component_id")
    assert found[5001] == (4, 1) and found == brute_groups(rows)


def test_jaccard_members_far_from_a_head_meet_those_of_other_heads(in_slices):
    """A chain of three texts, all of whose keys unrelated texts with smaller ids also have."""
    rng, rows = random.Random(100), []
    base = [f"w100x{j}" for j in range(8)]
    for i in range(80):
        start, before, width = rng.randrange(4), rng.randint(1, 8), rng.choice((5, 6))
        others = [f"f100x{i}x{j}" for j in range(20)]
        after = others[before : before + max(3 - before, 0) + 2]
        rows.append((i, " ".join([*others[:before], *base[start : start + width], *after])))
    rows += [(900, " ".join(["p", *base])), (901, " ".join(base)), (902, " ".join([*base, "q"])), (903, "z")]
    assert by_id(jaccard.join_groups(in_slices(rows)), "n_shingles", "component_id") == brute_groups(rows)


def groups_by_hand(rows):
    """doc_id, n_shingles and smallest id of the group of every row; rows of one id are told apart by their texts."""
    different = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    found = brute_groups([(i, text) for i, (_, text) in enumerate(different)])
    of = {row: (found[i][0], different[found[i][1]][0]) for i, row in enumerate(different)}
    return sorted((r[0], *of[r[0], r[1]]) for r in rows if r[0] is not None)


def test_jaccard_rows_of_one_id(make_docs, mixed_rows, spark):
    """Rows that repeat an id are in a group only if their texts link."""
    rng = random.Random(12)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(5, a), (5, b), (1, a), (5, b), (7, f"{b} more"), (7, c), (9, c), (5, None), (5, ""), (-2, "one"), (5, "one"), (None, a)]
    rows += [(100 + i % 5, t) for i, t, *_ in mixed_rows]
    found = jaccard.join_groups(make_docs(rows)).collect()
    assert sorted(tuple(r) for r in found if r["doc_id"] is not None) == groups_by_hand(rows)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, make_docs(rows[:7] + rows[-1:] + rows[11:12]), "").collect()]
    assert {(5, b), (1, a), (7, c), (None, a)} <= set(kept) and (5, a) not in kept and (7, f"{b} more") not in kept
    assert kept.count((5, b)) == 1


def test_jaccard_copies_meet_strangers_once(make_docs):
    """Clusters of copies and near copies that share a passage with each other and with a smaller id."""
    rng = random.Random(13)
    passage = words(rng, 30)
    rows = [(0, f"{words(rng, 40)} {passage}")]
    for cluster in range(6):
        own = words(rng, 60).split()
        for i in range(12):
            text = list(own)
            if i % 3:
                text[rng.randrange(60)] = f"edit{cluster}x{i}"
            rows.append((100 * cluster + i + 1, f"{' '.join(text)} {passage}"))
    assert by_id(jaccard.join_groups(make_docs(rows)), "n_shingles", "component_id") == brute_groups(rows)


def test_jaccard_keys_of_the_same_members_stand_once(make_docs, in_slices, monkeypatch):
    """Alike texts share many keys; slices and whole tasks count the same members."""
    rng, rows = random.Random(14), []
    for cluster in range(3):
        own = words(rng, 150).split()
        for i in range(9):
            text = list(own)
            for place in rng.sample(range(150), 1 + 2 * i):
                text[place] = f"edit{cluster}x{i}"
            rows.append((100 * cluster + i, " ".join(text)))
    side, seen = jaccard._side, []
    monkeypatch.setattr(jaccard, "_side", lambda rows, name: (name == "y" and seen.append(rows)) or side(rows, name))
    kept = []
    alone = jaccard.stored_alone
    monkeypatch.setattr(jaccard, "stored_alone", lambda spark, make: (found := alone(spark, lambda: kept_rows(make))))

    def kept_rows(make):
        found = make()
        while seen:
            kept.extend((r["key"], r["doc"]) for r in seen.pop().collect())
        return found

    assert by_id(jaccard.join_groups(make_docs(rows)), "n_shingles", "component_id") == brute_groups(rows)
    of = collections.defaultdict(set)
    for key, doc in kept:
        of[key].add(doc)
    assert len({frozenset(docs) for docs in of.values()}) == len(of) > 0
    assert all(len(docs) > 2 for docs in of.values())
    common = np.zeros(jaccard.SLOTS, bool)
    docs = in_slices(rows)
    sliced = jaccard.memberships(docs, common).filter("members IS NOT NULL").select("key", "members", "total").collect()
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    whole = jaccard.memberships(docs, common).filter("members IS NOT NULL").select("key", "members", "total").collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, whole)) and len(whole) > 0


def components_by_hand(links):
    smallest = {x: x for link in links if link[0] != link[1] for x in link}
    while any(smallest[a] != smallest[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    return sorted(smallest.items())


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components(spark, few, monkeypatch):
    """Paths, a hub, repeated links and links of a node with itself; by broadcasts and by shuffles."""
    monkeypatch.setattr(components, "FEW", few)
    path = random.Random(4).sample(range(-20, 20), 40)
    links = [*zip(path, path[1:25], strict=False), *zip(path[25:], path[26:], strict=False), *((100, i) for i in range(101, 140)), (7, 7), (200, 201), (201, 200), (300, 300)]
    found = components.component_ids(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == components_by_hand(links)


def test_jaccard_takes_few_shuffles(spark, make_docs, mixed_rows):
    """Every shuffle costs a task a partition, however little there is to do."""
    docs = make_docs(mixed_rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("shuffles", "")
    try:
        jaccard.join_groups(docs).collect()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("shuffles") for s in tracker.getJobInfo(job).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    run = [i for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]
    tasks = sum(i.numCompletedTasks for i in run)
    assert tasks <= 900, tasks


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    from presscan.llm.shingles import Sets

    for size in (1, 2, 3, 5, 7, 9, 14, 20, 33, 57, 101, 250, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            most = len(a) // 7
            b = np.unique(np.concatenate([a[most:], rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
            keys, owner = jaccard.index_keys(Sets(np.concatenate([a, b]), np.array([len(a), len(b)])), np.zeros(jaccard.SLOTS, bool))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def sets_by_hand(text):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(len(found) - 4, min(len(found), 1))))


def test_shingle_sets_are_those_of_plain_python():
    rng = random.Random(5)
    parts = ["a", "B", "b", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "é", "É", "\x00", "x\x00", "\xa0", "\x1f", "eightbyt", "ninebytes", "sixteen bytes it is", "日本"]
    texts = [None, "", " ", "A"] + ["".join(rng.choices(parts, k=rng.choice([1, 2, 4, 9, 30, 200]))) for _ in range(300)] + [None]
    whole = pa.array(texts)
    known = {}
    for array in (whole, whole.cast(pa.large_string()), whole.slice(2, 100), whole.slice(0, 1), pa.array([], pa.string())):
        sets = shingles.shingle_sets(array)
        assert len(sets.sizes) == len(array)
        for i, text in enumerate(array.to_pylist()):
            expected = sets_by_hand(text)
            assert sets.sizes[i] == len(expected) and (sets[i][1:] > sets[i][:-1]).all()
            assert known.setdefault(expected, sets[i].tolist()) == sets[i].tolist()
    assert len({tuple(s) for s in known.values()}) == len(known)


def test_shingles_take_no_python_call_a_word():
    calls = 0

    def count(frame, event, function):
        nonlocal calls
        calls += event in ("call", "c_call")

    texts = pa.array([" ".join(f"word{i}" for i in range(20_000))])
    shingles.shingle_sets(texts)
    sys.setprofile(count)
    try:
        sets = shingles.shingle_sets(texts)
    finally:
        sys.setprofile(None)
    assert sets.sizes.tolist() == [19_996] and calls < 2000


def cut_by_hand(rows):
    """What each row keeps: bytes go that lie in a window of a smaller id, or earlier in the row."""
    seen, out = {}, []
    for doc_id, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone, own = bytearray(len(data)), set()
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if seen.get(window, doc_id) < doc_id or window in own:
                gone[i : i + 100] = b"\1" * 100
            own.add(window)
            seen.setdefault(window, doc_id)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(data)))
        out.append((doc_id, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return sorted(out)


def brute_cuts(rows):
    return {r[0]: r[1:] for r in cut_by_hand(rows)}


def cuts_of(docs):
    return sorted((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in repeats.without_repeats(docs).collect())


@pytest.mark.parametrize(("crowd", "together"), [(repeats.CROWD, repeats.TOGETHER), (1, 700)])
def test_repeats(docs, mixed_rows, crowd, together, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "TOGETHER", together)
    assert cuts_of(docs) == cut_by_hand(mixed_rows)


def test_stretches_of_a_minimiser_go_on_only_if_they_share_a_window():
    """Texts that share a frequent phrase, some of them enough around it for a window, some one byte less."""
    rng, phrase = random.Random(21), "by the end of the following business day "
    def noise():
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
    around = [(noise(), noise()) for _ in range(30)]
    texts = [f"{a}{phrase}{z}".encode() for a, z in around]
    for n, (a, z) in enumerate(around[:20]):
        left = rng.randrange(60)
        texts.append(f"{noise()}#{a[150 - left:]}{phrase}{z[:59 - left - n % 2]}#{noise()}".encode())
    row, start, stop, gram, _, at = repeats.stretches(texts)
    shared = 0
    for value in set(gram.tolist()):
        group = [(int(row[i]), int(start[i]), int(stop[i]), int(at[i])) for i in (gram == value).nonzero()[0]]
        found = repeats.sharing([texts[r][a:b] for r, a, b, _ in group], [g[3] for g in group])
        places = {}
        for i, (r, a, b, _) in enumerate(group):
            for k in range(a, b - repeats.LENGTH + 1):
                places.setdefault(texts[r][k : k + repeats.LENGTH], []).append((i, k - a))
        kept = {i: (a, b) for i, a, b in found}
        for met in places.values():
            for i, k in met if len(met) > 1 else ():
                assert kept[i][0] <= k and k + repeats.LENGTH <= kept[i][1]
                shared += 1
        # Of the texts that share the phrase only, none goes on.
        assert all(group[i][0] < 20 or group[i][0] >= 30 for i in kept)
    assert shared >= 20


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_rows_of_one_id_keep_their_own_texts(make_docs, mixed_rows, crowd, monkeypatch):
    """Rows that repeat an id never cut each other, but both lose what a smaller id has."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(11)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(5, a), (5, b), (1, a), (5, f"{b} {c} {b}"), (7, f"{c} {d}"), (7, f"x {d}"), (9, f"{d} {b}"), (7, f"x {d}"), (-3, d[:150]), (5, None), (5, "")]
    rows += [(i % 7, t) for i, t, *_ in mixed_rows]
    assert cuts_of(make_docs(rows)) == cut_by_hand(rows)
    kept = sorted((r["doc_id"], r["text"]) for r in repeats.deduplicated(make_docs([(5, a), (5, b), (1, a)])).collect())
    assert kept == [(1, a), (5, b)]


def test_deduplicated_texts_are_valid(docs, mixed_rows, make_docs):
    out = repeats.deduplicated(docs)
    assert out.columns == docs.columns
    kept = by_id(out, "text")
    cuts = brute_cuts(mixed_rows)
    assert kept[1] == (None,) and kept[4] == ("one",) and 46 not in kept
    assert all(t is None or t == cuts[i][2].decode(errors="ignore") for i, (t,) in kept.items())
    assert len(repeats.deduplicated(make_docs([(None, "a" * 300), (None, "a" * 300)])).collect()) == 2


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(docs, mixed_rows, tokenizer):
    path, pattern, library = tokenizer
    coded = bpe.round_trip(docs, path, pattern).collect()
    texts = {r[0]: r[1] or "" for r in mixed_rows}
    for r in coded:
        text = texts[r["doc_id"]]
        assert bytes(r["ids"]) == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r["decoded"]) == text.encode()
    assert len(coded) == len(mixed_rows)
    apart = bpe.decode(bpe.encode(docs, path, pattern), path)
    assert {i: bytes(d) for i, (d,) in by_id(apart, "decoded").items()} == {i: t.encode() for i, t in texts.items()}


def test_long_words_contract_as_short_ones_do(tokenizer):
    path, _, library = tokenizer
    codec = bpe.Codec(bpe.read_ranks(path))
    rng = np.random.default_rng(5)
    for letters in ("ab", "etaoinshrdlu", "=-", "aaab"):
        word = "".join(rng.choice(list(letters), 300)).encode()
        for query in (bpe.CONTRACT, bpe.CONTRACT_LONG):
            codec._contract([word], query)
            # The library's own answer for the same bytes taken as one word.
            assert codec.known[word] == np.array(library._core_bpe.encode_single_piece(word), "<u4").tobytes()


def test_a_task_holds_the_tokens_of_one_megabyte(make_docs, monkeypatch):
    held = []

    class Counted(bpe.Codec):
        def __init__(self):
            pass

        def encode(self, texts, pattern):
            held.append(sum(map(len, texts)))
            return [b""] * len(texts)

    monkeypatch.setattr(bpe, "_codec", lambda ranks: Counted())
    monkeypatch.setattr(bpe, "read_ranks", lambda path: ())
    works = []
    monkeypatch.setattr(bpe, "tidy", lambda run, owner: works.append(run) or (lambda batches: batches))
    bpe.encode(make_docs([(1, "x")]), "", "x")
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["x" * 200_000] * 39 + ["x" * 1_500_000]})
    made = list(works[0](iter([batch])))
    # A text of more than that stands alone.
    assert max(held[:-1]) <= 1 << 20 and held[-1] == 1_500_000 and sum(map(len, made)) == 40


def test_languages(make_docs, mixed_rows, spark):
    import random

    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(3, 60), lang), lang if i % 3 else None) for i in range(1, 90) for lang in [("en", "fr")[i % 2]]]
    model = language_id.fit(make_docs([r for r in rows if r[2]]), language_id.default_vocabulary(spark))
    found = by_id(language_id.predict(make_docs(rows), model), "lang_pred")
    assert all(found[i] == (("en", "fr")[i % 2],) for i, *_ in rows)
    odd = by_id(language_id.predict(make_docs([(1, None), (2, ""), (3, "12 34 !"), (4, "x" * 5000), (5, "x" * 5000)]), model), "lang_pred", "score")
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0)
    assert odd[4] == odd[5] and 0 < odd[4][1] <= 1
    nothing = language_id.fit(make_docs([(1, "text", None)]), language_id.default_vocabulary(spark))
    assert by_id(language_id.predict(make_docs([(1, "text")]), nothing), "lang_pred", "score") == {1: ("und", 0.0)}


def test_segmentations_are_summed():
    pieces = (b"a", b"b", b" ", b"ab", b" a")
    trie = language_id.Pieces(pieces)
    p = np.array([[0.2], [0.3], [0.1], [0.25], [0.15]])
    total = language_id._Lattice(trie, [b" ab"]).log_totals(p)
    by_hand = 0.1 * 0.2 * 0.3 + 0.1 * 0.25 + 0.15 * 0.3
    assert np.exp(total[0, 0]) == pytest.approx(by_hand)
    run, piece, share = language_id._Lattice(trie, [b" ab"]).expected(p[:, 0])
    assert share[piece == 3].sum() == pytest.approx(0.1 * 0.25 / by_hand)


def test_long_words_are_summed_whole():
    """Against sums position by position, for words far beyond the range of plain products."""
    rng = random.Random(9)
    pieces = tuple({b" ", *(bytes([b]) for b in b"abcxyz"), *(bytes(rng.choices(b"abcxyz", k=rng.randint(2, 9))) for _ in range(150))})
    trie = language_id.Pieces(pieces)
    prior = np.array([rng.uniform(1e-9, 1e-2) for _ in pieces])
    samples = [bytes(rng.choices(b"abcxyz", k=k)) for k in (1, 5, 15, 16, 17, 31, 48, 49, 64, 200, 3000)]
    number = {p: i for i, p in enumerate(pieces)}

    def by_hand(word):
        n, spans = len(word), []
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        for i in range(n):
            for j in range(i + 1, min(n, i + trie.longest) + 1):
                if word[i:j] in number:
                    spans.append((i, j, number[word[i:j]]))
                    ahead[j] = np.logaddexp(ahead[j], ahead[i] + np.log(prior[spans[-1][2]]))
        for i, j, p in sorted(spans, reverse=True):
            behind[i] = np.logaddexp(behind[i], behind[j] + np.log(prior[p]))
        counts = np.zeros(len(pieces))
        for i, j, p in spans:
            counts[p] += np.exp(ahead[i] + np.log(prior[p]) + behind[j] - ahead[n])
        return ahead[n], counts

    for some, origin in language_id._chunks(samples, 1):
        lattice = language_id._Lattice(trie, some)
        totals = lattice.log_totals(prior[:, None])[:, 0]
        word, piece, share = lattice.expected(prior)
        for k in range(len(some)):
            total, counts = by_hand(b" " + samples[origin[k]])
            assert totals[k] == pytest.approx(total)
            assert np.bincount(piece[word == k], weights=share[word == k], minlength=len(pieces)) == pytest.approx(counts)


def test_licenses(make_docs):
    mit = "Permission to do. Released under the MIT License."
    wrapped = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use\nthis file except in compliance with the '
        "License. You may obtain a copy of\nthe License at\n http://www.apache.org/licenses/LICENSE-2.0\n\nMore software text."
    )
    rows = [(1, mit), (2, wrapped), (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (6, "no licence here")]
    found = by_id(licenses.scan(make_docs(rows)), "n_matches", "licences")
    assert found == {1: (1, "MIT"), 2: (1, "Apache-2.0"), 3: (0, ""), 4: (0, ""), 5: (3, "GPL-3.0, CC-BY-NC-4.0"), 6: (0, "")}


WARRANTY = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE'
BSD = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU {0}General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
NOTICES = {
    "Apache-2.0": """# Copyright 2020 Somebody
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
""",
    "MIT": "MIT License\n\nCopyright (c) 2020 Somebody\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n" + WARRANTY.strip(),
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": BSD + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "GPL-3.0-or-later": GPL.format(""),
    "AGPL-3.0-or-later": GPL.format("Affero "),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL-2.1-or-later": "// SPDX-License-Identifier: LGPL-2.1-or-later",
}


def test_standard_notices(make_docs, spark):
    """Whole notices as they stand in files; SQL says the same, on nulls, empty and repeated rows too."""
    texts = [*NOTICES.values(), "\n".join(NOTICES.values()), None, "", "no license here. v. 2", NOTICES["MIT"], "distributed in the hope"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (90, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")]
    found = licenses.scan(make_docs(rows)).collect()
    by_row = {r["doc_id"]: r for r in found}
    assert [by_row[i]["licences"] for i in range(len(NOTICES))] == list(NOTICES)
    assert all(by_row[i]["n_matches"] == 1 for i in range(len(NOTICES)))
    assert set(by_row[len(NOTICES)]["licences"].split(", ")) == set(NOTICES)
    assert [by_row[len(NOTICES) + i]["n_matches"] for i in range(1, 4)] == [0, 0, 0] and by_row[90]["n_sentences"] == 1
    import duckdb
    import pyarrow as pa

    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(map(repr, db.sql(licenses.scan_sql()).fetchall())) == sorted(repr(tuple(r)) for r in found)


def test_empty_tables(no_docs, tokenizer, spark):
    path, pattern, _ = tokenizer
    assert quality.judge(no_docs).count() == 0
    assert sharding.shard_documents(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert jaccard.join_groups(no_docs).count() == 0
    assert repeats.without_repeats(no_docs).count() == 0
    assert bpe.round_trip(no_docs, path, pattern).count() == 0
    assert licenses.scan(no_docs).count() == 0
    model = language_id.fit(no_docs, language_id.default_vocabulary(spark))
    assert language_id.predict(no_docs, model).count() == 0


def test_pipeline_of_nulls_or_nothing(spark):
    """Every stage takes rows without any value, and a table without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    nulls = spark.createDataFrame([(None,) * 5, (None,) * 5, (3, None, None, None, None), (4, "just a few words", None, None, None)], schema)
    for rows, n in ((nulls, 4), (nulls.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, "").count() <= 2 * n
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""))
        assert {r["doc_id"] for r in docs.collect()} <= {4}


def test_pipeline_stages_bound_the_bytes_handed_to_python(spark):
    """A stage that runs alone brings the setting along; 1200 texts of 20 kB are several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        stage(spark, spark.createDataFrame([], schema), "")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
    texts = spark.range(0, 1200, 1, 1).selectExpr("id", "repeat('0123456789', 2000) AS text")
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    assert max(r["n"] for r in sizes.collect()) <= 9 << 20


def test_stretches_take_little_memory():
    import tracemalloc

    rng = random.Random(15)
    texts = [bytes(rng.choices(b"abcdefgh ", k=4000)) for _ in range(400)]
    tracemalloc.start()
    found = sum(len(repeats.stretches(some)[0]) for some, _, _ in repeats.pieces(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 400 and peak < 25 << 20, peak


def test_pipeline_stages(make_docs, mixed_rows, spark):
    rows = [r for r in mixed_rows if r[0] != 7]
    docs = make_docs(rows)
    texts = {r[0]: r[1] for r in rows}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}")
        last, docs = docs, spark.read.parquet(path)
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == last.columns
    kept = {r["doc_id"] for r in seen["language_id"].collect()}
    assert kept == {i for i, t in texts.items() if re.search("[a-z]", t or "")}
    groups = brute_groups([r for r in rows if r[0] in kept])
    one_each = {i for i, (_, least) in groups.items() if i == least}
    assert {r["doc_id"] for r in seen["ngram_jaccard"].collect()} == one_each
    cuts = brute_cuts([r for r in rows if r[0] in one_each])
    assert {r["doc_id"]: r["text"] for r in seen["suffix_dedup"].collect()} == {
        i: kept.decode(errors="ignore") for i, (n, spans, kept) in cuts.items() if not spans or kept.strip()
    }
    copies = collections.Counter(r["doc_id"] for r in seen["source_mixing"].collect())
    assert set(copies) <= one_each and max(copies.values()) <= 2
    final = seen["byte_bpe"].collect()
    assert collections.Counter(r["doc_id"] for r in final) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256(cuts[r["doc_id"]][2].decode(errors="ignore").encode()).hexdigest() for r in final)
