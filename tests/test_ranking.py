from __future__ import annotations

import random

import presscan as ps
from presscan.operators.ranking import limit_leaves, row_number_all, top_n_per_group


def listed(spark, *groups: str):
    rows = [(g, i) for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, "site_key string, ord int")


def order_of(df):
    return [(r["site_key"], r["ord"]) for r in df.collect()]


def test_sites_take_turns(spark):
    assert [k for k, _ in order_of(ps.interleave(listed(spark, *"BBBAA"), order=("ord",)))] == list("BABAB")


def test_a_cap_keeps_every_site(spark):
    assert order_of(ps.interleave(listed(spark, *"BBBBBAAAAA"), order=("ord",), limit=4)) == [
        ("B", 0), ("A", 5), ("B", 1), ("A", 6),
    ]


def test_inner_order_and_empty_input(spark):
    assert order_of(ps.interleave(listed(spark, *"AAB"), order=("ord",))) == [("A", 0), ("B", 2), ("A", 1)]
    assert order_of(ps.interleave(listed(spark, "A").where("ord < 0"), order=("ord",), limit=3)) == []


def skewed(rng: random.Random, n: int) -> list[tuple[str, int]]:
    """A third of all rows belong to one group."""
    groups = ["hot"] * (n // 3) + [f"g{rng.randint(0, 20)}" for _ in range(n - n // 3)]
    rng.shuffle(groups)
    return [(g, i) for i, g in enumerate(groups)]


def test_numbering_is_exact_for_a_hot_group(spark):
    rows = skewed(random.Random(1), 3000)
    df = spark.createDataFrame(rows, "site_key string, ord int").repartition(16)
    got = {(r["site_key"], r["ord"]): r["_rn"] for r in row_number_all(df, ["site_key"], ["ord"]).collect()}
    counts, want = {}, {}
    for key, ord_ in rows:
        counts[key] = counts.get(key, 0) + 1
        want[key, ord_] = counts[key]
    assert got == want
    top = top_n_per_group(df, ["site_key"], ["ord"], 5).collect()
    assert {(r["site_key"], r["ord"]): r["_rn"] for r in top} == {k: n for k, n in want.items() if n <= 5}


def test_uncapped_and_capped_interleaving_agree_with_brute_force(spark):
    rows = skewed(random.Random(2), 900)
    df = spark.createDataFrame(rows, "site_key string, ord int").repartition(8)
    lists: dict[str, list] = {}
    for key, ord_ in rows:
        lists.setdefault(key, []).append((key, ord_))
    want = [lst[i] for i in range(max(map(len, lists.values()))) for lst in lists.values() if i < len(lst)]
    assert order_of(ps.interleave(df, order=("ord",))) == want
    assert order_of(ps.interleave(df, order=("ord",), limit=100)) == want[:100]


def test_keep_first_is_deterministic(spark):
    rows = [("u", 1, [0, 2], 0, "late"), ("u", 0, [0, 10], 5, "deep"), ("u", 0, [0, 2, 1], 9, "first"), ("v", 3, [0], 0, "only")]
    df = spark.createDataFrame(rows, "url string, site_ord int, path array<int>, entry_ord int, t string")
    assert {r["url"]: r["t"] for r in ps.keep_first(df).collect()} == {"u": "first", "v": "only"}


def test_entry_budget_on_documents_and_on_rows(spark):
    leaves = [(0, [0], "a", 3), (0, [1, 0], "b", 0), (0, [1, 1], "c", 4), (0, [2], "d", 1), (1, [0], "e", 9)]
    df = spark.createDataFrame(leaves, "site_ord int, path array<int>, url string, n_entries bigint")
    taken = lambda n: {r["url"]: r["take"] for r in limit_leaves(df, n).collect()}
    assert taken(5) == {"a": 3, "c": 2, "e": 5}
    assert taken(1) == {"a": 1, "e": 1}
    assert taken(100) == {"a": 3, "c": 4, "d": 1, "e": 9}
    entries = spark.createDataFrame([(0, [0], i) for i in range(5)] + [(1, [0], 0)], "site_ord int, path array<int>, entry_ord int")
    assert sorted((r["site_ord"], r["entry_ord"]) for r in ps.limit_scan(entries, 2).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("concat('hot', id div 1000000) AS url", "0 AS site_ord", "array(int(id)) AS path", "0 AS entry_ord")
    plan = ps.keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    ranked = top_n_per_group(df, ["url"], ["path"], 5)._jdf.queryExecution().executedPlan().toString()
    assert ranked.count("WindowGroupLimit") == 4
