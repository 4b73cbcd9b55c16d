"""How filters overlap: every order of five filters, and each filter's share by the potential of removal games.

A document's failing filters are a mask of five bits, so all 32 coalitions of filters are
decided by 32 counts a part: a coalition removes the documents whose mask meets it. Let
``v(S)`` be that number. The Hart-Mas-Colell potential is ``P(S) = (v(S) + sum of P(S - i)) / |S|``
with ``P`` of nobody 0, computed from small coalitions to large ones. A filter's Shapley value is
the potential of all filters less the potential of all but it, and what a step of an
order removes is the difference of two coalitions. ``|S|! P(S)`` is an integer, so
everything is exact.

Texts are read once. What is shuffled is a digest a document; documents are counted
before they meet labels or the earliest document of their text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import words
from presscan.session import stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALL = (1 << len(FILTERS)) - 1
_SEEN = 1 << FILTERS.index("E")


def text_failures(text: Column, tokens: Column) -> Column:
    """Mask of the filters A to D that a text (not null) of those words fails."""
    n = F.size(tokens).cast("long")
    failed = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(tokens)).cast("long") < 50 * n,
        100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > 2 * F.length(text).cast("long"),
        F.translate(text, SYMBOLS, "") != text,
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: how many documents of an id and a part fail just those filters.

    ``part`` is the source, empty for none. A null text is empty. E fails a document whose
    text (by SHA-256) a smaller id has; a document without an id has no smaller one.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", words(F.col("text")))
    mask = text_failures(F.col("text"), F.col("tokens"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    # One row for the copies that share id, part and text, before anything meets.
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = rows.join(first, ["doc_id", "digest"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return met.select("doc_id", "part", (F.col("mask") + F.when(copy, _SEEN).otherwise(0)).alias("mask"), "n")


def counted(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: arrays of 32 counts by mask of all documents (n), good (q) and toxic (t) ones.

    A document is good or toxic if any row of ``labels`` says so; one without an id has no label.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    # Documents without an id never meet a label, so they stay out of the join's keys.
    named = failed.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").drop("doc_id")
    rows = named.unionByName(failed.filter("doc_id IS NULL").drop("doc_id"), allowMissingColumns=True)
    sums = {"n": F.col("n"), "q": F.col("n") * F.coalesce("q", F.lit(0)), "t": F.col("n") * F.coalesce("t", F.lit(0))}
    cells = rows.groupBy("part", "mask").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    return cells.groupBy("part").agg(
        *[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(k))), F.lit(0)) for m in range(_ALL + 1)]).alias(k) for k in sums]
    )


def _removal_game(cells: str) -> Column:
    """v(S) of every coalition: the documents of cells whose mask meets it."""
    return F.expr(f"transform(sequence(0, {_ALL}), s -> aggregate(sequence(0, {_ALL}), 0L, (a, m) -> a + if((m & s) > 0, {cells}[m], 0L)))")


def _potentials(game: str) -> Column:
    """``|S|! P(S)`` of every coalition; each follows those that lack one of its filters."""
    smaller = f"aggregate(sequence(0, {len(FILTERS) - 1}), 0L, (a, i) -> a + if((s & shiftleft(1, i)) > 0, p[s - shiftleft(1, i)], 0L))"
    return F.expr(f"aggregate(sequence(1, {_ALL}), array(0L), (p, s) -> array_append(p, factorial(bit_count(s) - 1) * {game}[s] + {smaller}))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step.

    part, filter_order, step; kept after the step; removed by it; redundant (failing its
    filter, but gone before); unique_fails (failing no other filter); good_lost and toxic_lost
    (labelled ones among the removed); shapley (documents its filter removes, summed over all
    orders). A table without rows has no parts and gives none.
    """
    games = counted(failures(docs), labels).withColumns({f"v_{k}": _removal_game(k) for k in ("n", "q", "t")})
    games = stored(games.withColumn("potential", _potentials("v_n")).withColumn("total", F.expr("aggregate(n, 0L, (a, x) -> a + x)")))
    orders = F.explode(F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)]))
    rows = games.withColumn("filter_order", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    rows = rows.withColumn("alone", F.expr(bit.format("step")))
    rows = rows.withColumn("before", F.expr(f"aggregate(sequence(1, 5), 0, (a, i) -> a + if(i < step, {bit.format('i')}, 0))"))
    alone, after = F.col("alone"), F.col("before") + F.col("alone")
    removed = F.get("v_n", after) - F.get("v_n", F.col("before"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.get("v_n", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("v_n", alone) - removed).alias("redundant"),
        F.get("n", alone).alias("unique_fails"),
        (F.get("v_q", after) - F.get("v_q", F.col("before"))).alias("good_lost"),
        (F.get("v_t", after) - F.get("v_t", F.col("before"))).alias("toxic_lost"),
        (F.get("potential", F.lit(_ALL)) - len(FILTERS) * F.get("potential", F.lit(_ALL) - alone)).alias("shapley"),
    )


def audit_sql() -> str:
    """The same by counting documents of every order's steps; Shapley sums as the removed of all orders."""
    return f"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
        ), tokens AS (
            SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts
        ), failed AS (
            SELECT doc_id, part,
                [len(w) < {LEAST_WORDS},
                 100 * len(list_distinct(w)) < 50 * len(w),
                 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                 regexp_matches(text, '[#$%&*|]'),
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
            FROM tokens
        ), marks AS (
            SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS t FROM labels GROUP BY doc_id
        ), cells AS (
            SELECT part, f, count(*) AS n, count(*) FILTER (q = 1) AS q, count(*) FILTER (t = 1) AS t
            FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, f
        ), letters AS (SELECT unnest(range(1, 6)) AS i),
        perms AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
        ), steps AS (
            SELECT o, list_aggregate(list_transform(o, lambda i: substr('{FILTERS}', i, 1)), 'string_agg', '') AS filter_order, s AS step, o[s] AS x, o[1:s - 1] AS gone
            FROM perms, (SELECT unnest(range(1, 6)) AS s)
        ), met AS (
            SELECT c.part, s.filter_order, s.step, s.x, c.n, c.q, c.t, c.f[s.x] AS fails,
                coalesce(list_bool_or(list_transform(s.gone, lambda i: c.f[i])), false) AS before,
                len(list_filter(c.f, lambda b: b)) = 1 AS lone
            FROM cells c, steps s
        ), counts AS (
            SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
                CAST(coalesce(sum(n) FILTER (NOT before AND NOT fails), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (NOT before AND fails), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (before AND fails), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (fails AND lone), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(q) FILTER (NOT before AND fails), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(t) FILTER (NOT before AND fails), 0) AS BIGINT) AS toxic_lost
            FROM met GROUP BY ALL
        )
        SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counts
    """
