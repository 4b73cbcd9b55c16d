"""Top-k search and toxicity against plain Python and held-out labels."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from presscan.llm import topk, toxicity
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)], 0, "x") for i in range(300)]
    rows += [(300, None, 0, "x"), (301, [1.0, None], 0, "x"), (302, [float("nan")] * 8, 0, "x"), (303, [float("inf")] * 8, 0, "x")]
    rows += [(304, rows[5][1], 0, "x"), (305, rows[5][1], 0, "x"), (306, [0.5, 0.5], 0, "x"), (307, [], 0, "x"), (None, rows[5][1], 0, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").repartition(5)


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(vectors, block):
    given = {r["vec_id"]: r["v"] for r in topk.quantized(vectors).collect()}
    assert set(given) == {*range(300), 304, 305, 306, 307}
    quantized = topk.quantized(vectors)
    found = topk.top_k(quantized, quantized.filter("vec_id % 50 = 0 OR vec_id = 306"), query_block=block)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    expected = []
    for q in [*range(0, 300, 50), 306]:
        scores = sorted((-sum(a * b for a, b in zip(given[q], v, strict=False)), i) for i, v in given.items() if i != q)
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    assert got == sorted(expected)


def test_bounds_leave_less_than_half_to_evaluate(spark):
    given = topk.quantized(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).coalesce(4)
    asked = given.filter("vec_id % 100 = 0")
    evaluated = spark.sparkContext.accumulator(0)
    topk.top_k(given, asked, evaluated=evaluated).count()
    assert 0 < evaluated.value < 0.5 * given.count() * asked.count()


def test_top_k_of_few_or_none(vectors):
    quantized = topk.quantized(vectors)
    few = quantized.filter("vec_id < 4")
    assert topk.top_k(few, few.filter("vec_id = 0")).count() == 3
    none = quantized.filter("vec_id < 0")
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(quantized, none).count() == 0


def test_toxicity_on_unseen_texts(make_docs, spark):
    rng = random.Random(4)

    def text(toxic: bool) -> str:
        w = words(rng, rng.randint(40, 200)).split()
        for _ in range(len(w) // 25 + 1 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(("vilezak", "grumok", "skelbin")) + rng.choice(("", "s", "ly")))
        return " ".join(w)

    rows = [(i, text(i % 5 == 0), i % 5 == 0) for i in range(600)]
    labelled = spark.createDataFrame([(t, int(x)) for _, t, x in rows[:400]] + [(None, 1), ("text", None)], "text string, toxic int")
    unseen = [(i, t) for i, t, _ in rows[400:]] + [(700, None), (701, ""), (702, rows[0][1]), (702, rows[0][1])]
    scores: dict = {}
    for r in toxicity.score(make_docs(unseen), labelled).collect():
        scores.setdefault(r["doc_id"], []).append(r["score"])
    right = sum((scores[i][0] >= 0.5) == x for i, _, x in rows[400:])
    assert right >= 195
    assert scores[700] == scores[701] and scores[700][0] < 0.5
    assert len(scores[702]) == 2 and all(0 <= s <= 1 for v in scores.values() for s in v)


def ratios_by_hand(texts, words):
    """Log-likelihood ratio of each word, from dictionaries of strings: discounted counts, continuation counts below."""
    counts = [collections.Counter(), collections.Counter()]
    tops = set()
    for text, toxic in texts:
        for word in text.split():
            s = f" {word}\x01"
            for end in range(1, len(s)):
                longest = min(end + 1, 5)
                for m in range(1, longest + 1):
                    counts[toxic][s[end - m + 1 : end + 1]] += 1
                tops.add(s[end - longest + 1 : end + 1])
    seen = set(counts[0]) | set(counts[1])
    contexts = collections.Counter(g[1:] for g in seen if len(g) > 1)
    shared, floor = {}, 1 / 65536

    def discounted(grams, count, below, strength=0.0):
        total, kinds = collections.Counter(), collections.Counter()
        for g in grams:
            total[g[:-1]] += count(g)
            kinds[g[:-1]] += count(g) > 0
        values, back = {}, {}
        for g in grams:
            h = g[:-1]
            back[h] = (0.75 * kinds[h] + strength) / (total[h] + strength) if total[h] else 1.0
            share = max(count(g) - 0.75, 0) / (total[h] + strength) if total[h] else 0.0
            values[g] = share + back[h] * below(g)
        return values, back

    weight = [{}, {}]
    for m in range(1, 6):
        some = [g for g in seen if len(g) == m and g not in tops]
        if some:
            values, back = discounted(some, lambda g: contexts[g], lambda g: shared[g[1:]] if len(g) > 1 else floor)
            shared |= values
            if m == 1:
                floor *= back[""]
            else:
                weight[0] |= back
                weight[1] |= back
    both, pooled = discounted(tops, lambda g: counts[0][g] + counts[1][g], lambda g: max(shared.get(g[1:], 0), floor))
    value = []
    for c in range(2):
        own, back = discounted(tops, counts[c].__getitem__, both.__getitem__, 50.0)
        value.append(shared | own)
        weight[c] |= {h: back[h] * pooled[h] for h in back}
    out = []
    for word in words:
        s, total = f" {word}\x01", 0.0
        for end in range(1, len(s)):
            logs = []
            for c in range(2):
                p = floor
                for m in range(1, min(end + 1, 5) + 1):
                    g = s[end - m + 1 : end + 1]
                    found = value[c].get(g, 0)
                    p = found if found > 0 else (weight[c].get(g[:-1], 1.0) if m > 1 else 1.0) * p
                logs.append(math.log(max(p, 1e-30)))
            total += logs[1] - logs[0]
        out.append(total)
    return out


@pytest.mark.parametrize("held", [toxicity.HELD, 50])
def test_toxicity_model_by_hand(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD", held)
    monkeypatch.setattr(toxicity, "MARGIN", 0.0)
    rng = random.Random(8)
    texts = [(words(rng, rng.randint(1, 30)), int(rng.random() < 0.3)) for _ in range(60)] + [("ab", 1), ("ab ba", 0), ("é", 1)]
    labelled = spark.createDataFrame(texts, "text string, toxic int").repartition(4)
    model = toxicity._smooth(toxicity._gather(labelled).toArrow().to_pandas())
    asked = ["the", "ing", "ab", "unseen", "é", "x", "tion", "zzzzzzzz"]
    found, size = toxicity._word_values([w.encode() for w in asked], model)
    assert size.tolist() == [len(w) + 1 for w in asked]
    assert found == pytest.approx(ratios_by_hand(texts, asked), abs=1e-4)


def test_toxicity_without_labels(make_docs, spark):
    nothing = spark.createDataFrame([], "text string, toxic int")
    assert [r["score"] for r in toxicity.score(make_docs([(1, "text")]), nothing).collect()] == [0.0]
    only = spark.createDataFrame([("text", 1)], "text string, toxic int")
    assert [r["score"] for r in toxicity.score(make_docs([(1, "text")]), only).collect()] == [1.0]
    assert toxicity.score(make_docs([(1, "x")]).filter("doc_id > 1"), only).count() == 0
