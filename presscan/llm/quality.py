"""Quality by weak supervision.

Eight rules look at a document and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the counts of vote patterns estimates how often
each rule is right and how common good documents are, without labels. A document
stays if no base rule fails and its posterior probability of being good is at
least one half. All of it is DataFrame and SQL functions; features are row-local,
and only the model (one row) reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import WHITE, words
from presscan.session import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
ITERATIONS = 25
#: Bounds of a rule's rates: it passes good documents more often than not, and is never infallible.
PASSES_GOOD = (0.6, 0.999)
CATCHES_BAD = (0.02, 0.999)
#: Bad documents are the minority.
PRIOR = (0.5, 0.98)
START = (0.8, 0.995, 0.4)


@dataclass(frozen=True)
class QualityModel:
    """Share of good documents; per rule how often its vote is right on good and on bad ones."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def _repeat_words(n_words: str) -> Column:
    """Words inside 8-word windows found twice or more, from the hashes ``wh`` of the words.

    Window hashes are first sorted as plain numbers. Only a text with equal ones
    sorts them again with their places, which come out as lengths of covered runs.
    """
    starts = f"sequence(1, {n_words} - {WINDOW - 1})"
    pairs = f"sort_array(transform({starts}, i -> struct(windows[i - 1] AS k, i AS i)))"
    places = (
        f"transform(array({pairs}), p -> array_sort(array_distinct(flatten(zip_with("
        "p, slice(p, 2, size(p)), (a, b) -> if(a.k = b.k, array(a.i, b.i), array())))))) [0]"
    )
    covered = (
        f"aggregate({places}, struct(0L AS n, -{WINDOW} AS last), "
        f"(s, i) -> struct(s.n + least({WINDOW}, i - s.last) AS n, i AS last), s -> s.n)"
    )
    return F.expr(f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE {covered} END")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts the rules look at; a null text has no words and no lines."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("upper"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).alias("letters"),
    )
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.filter("w", lambda x: F.translate(x, SYMBOLS, "") != x)).cast("long").alias("n_marked"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "upper",
        "letters",
    )
    windows = f"CASE WHEN n_words < {WINDOW} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(1, CAST(n_words AS int) - {WINDOW - 1}), i -> xxhash64(slice(wh, i, {WINDOW}))) END"
    rows = rows.withColumn("windows", F.expr(windows)).drop("wh")
    return rows.withColumn("n_repeat_words", _repeat_words("CAST(n_words AS int)")).drop("windows")


def votes() -> Column:
    """The rules' votes as an array; columns of :func:`features`."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean = c("word_chars") / n
    return F.array(
        vote(c("n_words") < 20, c("n_words") >= 40),
        vote((mean < 2) | (mean > 14), (mean >= 3) & (mean <= 11)),
        vote(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        vote(10 * c("n_dup_lines") > 3 * c("n_lines"), c("n_dup_lines") == 0),
        vote(100 * c("n_repeat_words") > 30 * n, 100 * c("n_repeat_words") <= 10 * n),
        vote(2 * c("upper") > c("letters"), 5 * c("upper") <= c("letters")),
        vote(4 * c("letters") < 3 * c("word_chars"), 10 * c("letters") >= 9 * c("word_chars")),
        vote(5 * c("n_marked") > n, 50 * c("n_marked") <= n),
    )


def fit(voted: DataFrame) -> QualityModel:
    """Expectation-maximisation over vote patterns (at most 3 to the power of rules).

    A rule has two accuracies: how often it votes good on good documents and bad
    on bad ones. An abstention says nothing. The good votes of a rule that most bad
    documents pass therefore weigh little, its bad votes much.
    """
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p")).filter("size(p) > 0")
    odds = (
        "aggregate(zip_with(x.votes, m.rates, (v, r) -> CASE v WHEN 1 THEN ln(r.s / (1 - r.t)) "
        "WHEN -1 THEN ln((1 - r.s) / r.t) ELSE 0D END), ln(m.prior / (1 - m.prior)), (a, y) -> a + y)"
    )
    expected = f"transform(p, x -> struct(x.votes AS votes, x.n AS n, 1 / (1 + exp(-({odds}))) AS q))"

    def total(value: str) -> str:
        return f"aggregate(e, 0D, (a, x) -> a + x.n * {value})"

    def rate(share: str, vote: int, bounds: tuple[float, float]) -> str:
        part = f"try_divide({total(f'{share} * int(x.votes[j] = {vote})')}, {total(f'{share} * abs(x.votes[j])')})"
        return f"greatest({bounds[0]}D, least({bounds[1]}D, coalesce({part}, 0.9D)))"

    rules = "sequence(0, size(p[0].votes) - 1)"
    rates = (
        f"transform({rules}, j -> transform(array(struct({rate('x.q', 1, PASSES_GOOD)} AS s, {rate('(1 - x.q)', -1, CATCHES_BAD)} AS t)), "
        "r -> struct(r.s AS s, greatest(r.t, 1.001D - r.s) AS t))[0])"
    )
    prior = f"greatest({PRIOR[0]}D, least({PRIOR[1]}D, {total('x.q')} / {total('1')}))"
    step = f"transform(array({expected}), e -> struct({prior} AS prior, {rates} AS rates))[0]"
    start = f"struct({START[0]}D AS prior, transform({rules}, j -> struct({START[1]}D AS s, {START[2]}D AS t)) AS rates)"
    model = one.select(F.expr(f"aggregate(sequence(1, {ITERATIONS}), {start}, (m, _) -> {step})").alias("m")).first()
    if model is None:
        return QualityModel(START[0], (START[1],) * 8, (START[2],) * 8)
    return QualityModel(
        model["m"]["prior"], tuple(r["s"] for r in model["m"]["rates"]), tuple(r["t"] for r in model["m"]["rates"])
    )


def posterior(model: QualityModel) -> Column:
    """Probability of good, from the column ``votes``."""
    logit = F.lit(log(model.prior / (1 - model.prior)))
    for j, (s, t) in enumerate(zip(model.on_good, model.on_bad, strict=True)):
        vote = F.col("votes")[j]
        logit = logit + F.when(vote == 1, log(s / (1 - t))).when(vote == -1, log((1 - s) / t)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, votes, posterior and verdict.

    Empty and null texts fail the base rules. A table without rows gives none.
    """
    voted = stored(features(docs).withColumn("votes", votes()))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        posterior(fit(voted)).alias("posterior"),
        "votes",
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def judge_sql() -> str:
    """Counts and verdict in DuckDB; each step of expectation-maximisation is a step of a recursion."""
    rules, space = range(1, 9), r"\x20\x09-\x0D"
    good = [
        "n >= 40", "word_chars >= 3 * m AND word_chars <= 11 * m", "50 * n_symbols <= m", "n_dup_lines = 0",
        "100 * n_repeat_words <= 10 * m", "5 * upper <= letters", "10 * letters >= 9 * word_chars", "50 * n_marked <= m",
    ]
    bad = [
        "n < 20", "word_chars < 2 * m OR word_chars > 14 * m", "10 * n_symbols > m", "10 * n_dup_lines > 3 * n_lines",
        "100 * n_repeat_words > 30 * m", "2 * upper > letters", "4 * letters < 3 * word_chars", "5 * n_marked > m",
    ]
    votes = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v{j}" for j, b, g in zip(rules, bad, good, strict=True))
    each = ", ".join(f"v{j}" for j in rules)
    odds = "ln(p / (1 - p)) + " + " + ".join(f"(CASE v{j} WHEN 1 THEN ln(s{j} / (1 - t{j})) WHEN -1 THEN ln((1 - s{j}) / t{j}) ELSE 0 END)" for j in rules)

    def rate(share: str, vote: int, j: int, low: float, high: float) -> str:
        part = f"sum(c * {share}) FILTER (v{j} = {vote}) / nullif(sum(c * {share}) FILTER (v{j} <> 0), 0)"
        return f"greatest({low}::DOUBLE, least({high}::DOUBLE, CASE WHEN sum(c * {share}) FILTER (v{j} <> 0) > 0 THEN coalesce({part}, 0) ELSE 0.9 END))"

    steps = ", ".join(f"{rate('q', 1, j, *PASSES_GOOD)} AS s{j}, {rate('(1 - q)', -1, j, *CATCHES_BAD)} AS u{j}" for j in rules)
    start = ", ".join(f"{START[1]}::DOUBLE AS s{j}, {START[2]}::DOUBLE AS t{j}" for j in rules)
    rates = ", ".join(f"s{j}, greatest(u{j}, 1.001::DOUBLE - s{j}) AS t{j}" for j in rules)
    return f"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^{space}]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{space}]')) AS l
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        ), starts AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times
            FROM (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts))
        ), covered AS (
            SELECT doc_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n_repeat_words
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM starts WHERE times > 1) GROUP BY doc_id
        ), counted AS (
            SELECT doc_id, len(w) AS n, greatest(len(w), 1) AS m, length(regexp_replace(text, '[{space}]+', '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS upper,
                length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS letters, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS n_marked
            FROM texts LEFT JOIN covered USING (doc_id)
        ), voted AS (SELECT *, {votes} FROM counted),
        patterns AS (SELECT {each}, count(*)::DOUBLE AS c FROM voted GROUP BY {each}),
        model AS (
            SELECT 0 AS step, {START[0]}::DOUBLE AS p, {start}
            UNION ALL
            SELECT step, p, {rates} FROM (
                SELECT step + 1 AS step, greatest({PRIOR[0]}::DOUBLE, least({PRIOR[1]}::DOUBLE, sum(c * q) / sum(c))) AS p, {steps}
                FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS q FROM model, patterns WHERE step < {ITERATIONS}) GROUP BY step
            )
        ), judged AS (
            SELECT voted.*, n < 20 OR 100 * n_repeat_words > 30 * n AS base_failed, 1 / (1 + exp(-({odds}))) AS posterior
            FROM voted, (SELECT * FROM model WHERE step = {ITERATIONS})
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
            CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
            NOT base_failed AND posterior >= 0.5 AS kept
        FROM judged
    """
