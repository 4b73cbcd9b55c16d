from __future__ import annotations

import random

import pytest

#: Names that operators use themselves, on columns they must not mind.
CLASHING = "key string, head long, size string, shard int, score string, lang_pred string, block int, weight double, kept string, toxic string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def words(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": "the and ing tion er wh st ly ou th", "fr": "eau oui le qu é ment ai ère ç on"}[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows: list[tuple]):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        extra = ("x", 1, "x", 1, "x", "x", 1, 1.0, "x", "x")
        return spark.createDataFrame([(*r, *extra) for r in full], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def mixed_rows():
    """Nulls, empty, short and long texts, exact and near copies, a shared passage, repeated letters."""
    rng = random.Random(7)
    rows: list[tuple] = [
        (1, None, None, None),
        (2, "", "en", None),
        (3, " \n\t", None, "a"),
        (4, "one", "en", "a"),
        (5, "one two three four", "en", "b"),
        (6, "One TWO three four", "en", "b"),
        (7, "éè \U0001f600 \x00 x" * 40, "fr", "b"),
        (8, "a" * 1000, "en", "c"),
        (9, "ab " * 400, "en", "c"),
    ]
    passage = words(rng, 70)
    for i in range(10, 22):
        rows.append((i, words(rng, rng.randint(30, 120), rng.choice(("en", "fr"))), rng.choice(("en", "fr")), "a"))
    for i in range(22, 30):
        rows.append((i, f"{words(rng, 90)} {passage} {words(rng, 20)}", "en", "b"))
    base = words(rng, 200).split()
    for i in range(30, 45):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = "changed"
        rows.append((i, " ".join(near), "en", "c"))
    rows += [(45, rows[12][1], "en", "a"), (46, rows[12][1], "en", "b"), (47, words(rng, 9000), "en", "a")]
    return rows
