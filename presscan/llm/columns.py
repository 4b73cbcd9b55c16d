"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presscan.session import stored

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\u000b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes; none for a null text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def words(text: Column) -> Column:
    """The words of a text in order; empty for a null text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of an id's decimal text, modulo ``buckets``: how rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % buckets


def partitions(spark: SparkSession) -> int:
    """The number of partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, their place from 0 in the given order of all, stored.

    Ranges of the order are sorted apart; a place is that in the range plus the rows of the ranges
    before, of which there are as many as a shuffle has partitions.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()))
    number = F.shiftright("place", 33)
    starts, before = [], 0
    for row in placed.groupBy(number.alias("range")).count().orderBy("range").collect():
        starts.append((row["range"], before))
        before += row["count"]
    ranges = F.broadcast(rows.sparkSession.createDataFrame(starts, "range long, start long"))
    place = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(ranges, number == F.col("range")).withColumn("place", place).select(*rows.columns, "place")


#: The column that :func:`with_row_keys` adds.
KEY = "__key"


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with a number ``__key`` that tells rows of one id and different texts apart, and its shift.

    Keys have the order of the ids: ``key >> shift`` is as large as another's where the id is. Without
    rows that repeat an id the key is the id and the shift 0. Texts are told apart by a
    64-bit hash; rows alike in id and text share a key. Rows without an id have none.
    """
    rows = docs.withColumn(KEY, F.col("doc_id").cast("long"))
    if rows.filter(F.col(KEY).isNotNull()).groupBy(KEY).count().filter("count > 1").isEmpty():
        return rows, 0
    rows = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    placed = stored(in_order(rows.filter(F.col("__id").isNotNull()).select("__id", "__text").distinct(), F.asc("__id"), F.asc("__text")))
    firsts = placed.groupBy("__id").agg(F.min("place").alias("first"))
    numbered = stored(placed.join(firsts, "__id").select("__id", "__text", "first", (F.col("place") - F.col("first")).alias("sibling")))
    shift = max(int(numbered.agg(F.max("sibling")).first()[0]).bit_length(), 1)
    key = F.shiftleft("first", shift) + F.col("sibling")
    numbered = numbered.select("__id", "__text", key.alias(KEY))
    return rows.join(numbered, ["__id", "__text"], "left").select(*docs.columns, KEY), shift


#: Rows of a few numbers that an executor holds easily (tens of MB).
FEW = 500_000


def broadcast_if_few(stored_rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for a broadcast if it is counted to be small.

    Beyond :data:`FEW` rows the join is Spark's choice, by shuffling both sides.
    """
    return F.broadcast(stored_rows) if stored_rows.count() <= FEW else stored_rows
