"""Importance resampling towards a target distribution, without replacement.

Words hash to buckets; a bucket's gain says how much likelier the target's words are to
lie in it than the raw documents'. A document's weight is the sum of its words' gains, and
its score adds Gumbel noise that depends on seed and id alone, so the highest scores are a
draw by weight that reruns repeat.

Gains are one array of numbers, which tasks look words up in. Scores are written once. The
cutoff is found by bisection: jobs count exactly how many rows reach a threshold, several
thresholds a pass, first on scores, then on the ids of rows tied at the cutoff. Only the drawn
rows are sorted, by ranges, and ranks follow from the sizes of the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presscan.llm.columns import partitions
from presscan.llm.wordbatch import slices, tidy
from presscan.session import stored

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Thresholds that a counting job tries at once: four halvings a pass.
WAYS = 16
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST_ID = (1 << 63) - 1


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, in order, and the text it stands in; A-Z in lower case, a null text has none."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_SEPARATORS)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), parts.value_lengths().to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    row = row[filled.to_numpy(zero_copy_only=False)]
    encoded = flat.filter(filled).dictionary_encode()
    distinct = encoded.dictionary.cast(pa.binary()).to_pylist()
    bucket = np.fromiter((crc32(w) % BUCKETS for w in distinct), np.int32, len(distinct))
    return bucket[encoded.indices.to_numpy(zero_copy_only=False)], row


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Words of all texts in each bucket. Tasks add up their texts, Spark adds up tasks, and one number a bucket is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                seen += np.bincount(word_buckets(part.column("text"))[0], minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for row in docs.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed target share over its smoothed raw share, rounded down."""
    all_raw, all_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = ((t + 1.0) * all_raw / ((s + 1.0) * all_target) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([floor(1000 * log(r)) for r in ratios], np.int64)


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from seed and id; a null id is an empty one."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bucket, row = word_buckets(part.column("text"))
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                sums = np.concatenate([[0], np.cumsum(shared.value[bucket])])
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                columns = [part.column("doc_id"), pa.array((ends - starts).astype(np.int64)), pa.array((sums[ends] - sums[starts]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def _largest(rows: DataFrame, value: Column, wanted: int) -> int:
    """The largest threshold that at least ``wanted`` rows reach; there are that many, and one is wanted at least."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        gap = max((high - low) // WAYS, 1)
        tries = list(range(low + 1, high + 1, gap)) if high - low < WAYS else [low + (high - low) * i // WAYS for i in range(1, WAYS)] + [high]
        found = rows.agg(*[F.count(F.when(value >= F.lit(t), True)) for t in tries]).first()
        reached = [t for t, n in zip(tries, found, strict=True) if n >= wanted]
        missed = [t for t, n in zip(tries, found, strict=True) if n < wanted]
        low, high = max([low, *reached]), min([high, *(t - 1 for t in missed)])
    return low


@dataclass(frozen=True)
class Cutoff:
    """Rows above ``score`` are drawn, and of those at it the ones up to ``last_id`` (a null id is the last)."""

    size: int
    score: int
    last_id: int

    def drawn(self) -> Column:
        at = F.col("score") == self.score
        return (F.col("score") > self.score) | (at & (_id() <= F.lit(self.last_id)))


def _id() -> Column:
    return F.coalesce("doc_id", F.lit(_LAST_ID))


def cutoff(eligible: DataFrame, size: int) -> Cutoff | None:
    """Where the ``size`` highest scores end, ties to the smaller id; none if nothing is drawn."""
    if size <= 0:
        return None
    score = _largest(eligible, F.col("score"), size)
    above, at = eligible.agg(F.count(F.when(F.col("score") > score, True)), F.count(F.when(F.col("score") == score, True))).first()
    if above + at == size:
        return Cutoff(size, score, _LAST_ID)
    # The smallest id up to which enough rows lie is the largest one of their negatives.
    tied = eligible.filter(F.col("score") == score)
    return Cutoff(size, score, -1 - _largest(tied, -1 - _id(), size - above))


def ranked(drawn: DataFrame, size: int) -> DataFrame:
    """``drawn`` with rank by falling score and rising id; rows that repeat the last id beyond ``size`` have none.

    Ranges of the order are sorted apart; a row's rank is its place in its range after the rows of
    the ranges before. Rows alike in score and id may fill several ranges.
    """
    order = [F.desc("score"), F.asc(_id()), F.asc("n_features"), F.asc("tie")]
    dealt = drawn.repartitionByRange(partitions(drawn.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()))
    number, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, before = [], 0
    for row in placed.groupBy(number.alias("range")).count().orderBy("range").collect():  # one a range
        offsets.append((row["range"], before))
        before += row["count"]
    starts = F.broadcast(drawn.sparkSession.createDataFrame(offsets, "range long, start long"))
    rank = F.col("start") + inside + 1
    return placed.join(starts, number == F.col("range"), "left").withColumn("rank", F.when(rank <= size, rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; only drawn ones have a rank.

    Drawn are the highest scores, ``percent`` of the documents with enough words, ties to
    the smaller id. ``target`` holds the texts whose distribution is wanted. Null and empty
    texts have no features and weigh 0. A null id counts as an empty one in the noise and
    comes last among ties; rows that repeat an id are documents of their own. A table
    without rows gives none; with an empty target all gains come from the raw counts.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = stored(scored(docs, gain).withColumn("tie", F.monotonically_increasing_id()))
    enough = F.col("n_features") >= least_words
    end = cutoff(rows.filter(enough), percent * rows.filter(enough).count() // 100)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long").alias("rank")
    if end is None:
        return rows.select(*names[:-1], none)
    drawn = enough & end.drawn()
    left = rows.filter(~drawn).select(*names[:-1], none)
    return ranked(rows.filter(drawn), end.size).select(*names).unionByName(left)


def resample_sql() -> str:
    """The same with one sort; crc32 by its table, which its rule gives."""
    polynomial = 0xEDB88320
    return f"""
        WITH crc AS (
            SELECT list(c ORDER BY n) AS t FROM (
                SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, {polynomial}) ELSE c // 2 END) AS c
                FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
            )
        ), texts AS (
            SELECT 0 AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
            UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark
        ), tokens AS (
            SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts
        ), vocabulary AS (
            SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM tokens)
        ), hashed AS (
            SELECT w, xor(list_reduce(
                list_concat([4294967295], list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % {BUCKETS} AS bucket
            FROM vocabulary, crc
        ), counts AS (
            SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM tokens JOIN hashed USING (w) GROUP BY bucket
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM counts
        ), weights AS (
            SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM tokens JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
        ), scores AS (
            SELECT id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(id, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM texts LEFT JOIN weights USING (r) WHERE side = 0
        ), ranks AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
                count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS total
            FROM scores
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * total // 100 THEN place END AS rank FROM ranks
    """
