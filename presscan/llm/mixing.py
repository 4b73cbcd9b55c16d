"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies: its
source's target over its source's words. The whole part is taken as it is. The
rest is rounded in pairs: words are moved from one side to the other, in either
direction at random so that expectations hold, until one of the two is taken or
left whole. The words of a source are thus kept to within one small document.

Rounding is a reduction tree. The leaves are blocks of a source by a hash of the
row (its id, its text and its number among equal rows, so rows without an id or that
repeat one are dealt out too), each of bounded size and rounded large documents first;
at most one document of a block stays fractional, and blocks' residuals meet block by
block until one a source is left, which its own probability decides. Draws are hashes
of the rows that meet, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presscan.llm.columns import words
from presscan.session import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 1024
FAN_IN = 64

_OPEN = "row long, doc_id long, key long, size long, source_rank int, block long, whole long, part double"


def _uniform(*numbers: int) -> float:
    """A number in [0, 1) that depends on the given ones only (splitmix finaliser)."""
    state = 0x9E3779B97F4A7C15
    for n in numbers:
        state = (state ^ (n & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        state = (state ^ state >> 31) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 30
    return (state >> 11) / (1 << 53)


def _round_pairs(ids: list[int], sizes: list[int], parts: list[float], seed: int) -> list[float]:
    """Shares of the documents after rounding in the given order; at most one stays fractional."""
    mass = [s * p for s, p in zip(sizes, parts, strict=True)]
    first = None
    for second, size in enumerate(sizes):
        if not 0 < mass[second] < size:
            continue
        if first is None:
            first = second
            continue
        up = min(sizes[first] - mass[first], mass[second])
        down = min(mass[first], size - mass[second])
        if _uniform(seed, ids[first], ids[second]) * (up + down) < down:
            full, empty = up == sizes[first] - mass[first], up == mass[second]
            mass[first] = float(sizes[first]) if full else mass[first] + up
            mass[second] = 0.0 if empty else mass[second] - up
        else:
            empty, full = down == mass[first], down == size - mass[second]
            mass[first] = 0.0 if empty else mass[first] - down
            mass[second] = float(size) if full else mass[second] + down
        if not 0 < mass[first] < sizes[first]:
            first = second if 0 < mass[second] < size else None
    return [m / s if s else 0.0 for m, s in zip(mass, sizes, strict=True)]


def _round_block(ids: list[int], sizes: list[int], part: float, seed: int) -> list[float]:
    """Shares of a block's documents, large ones first, that all start with ``part``.

    Each document is paired with the pool of all smaller ones: words move between
    the two until the document is taken or left whole, and the pool's members share
    what it gained or lost alike. When the pool is too small for that, its documents
    are paired with each other. What stays fractional is thus a small document.
    """
    shares, pool = [], sum(sizes)
    for i, size in enumerate(sizes):
        pool -= size
        up, down = size * (1 - part), size * part
        if not 0 < part < 1 or pool * part < up or pool * (1 - part) < down:
            return shares + _round_pairs(ids[i:], sizes[i:], [part] * (len(ids) - i), seed)
        taken = _uniform(seed, ids[i], i) * (up + down) < down
        shares.append(float(taken))
        part = min(max(part - up / pool if taken else part + down / pool, 0.0), 1.0)
    return shares


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size; one row a source) with source_rank and target.

    Targets share ``share`` of all sizes by weight and stop at ``most`` times the
    source's size; what is above is shared again. The stable outcome is a level by
    which uncapped sources are multiples of their weight: sources are capped in the
    order of size over weight as long as the level of the rest lies above them.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    earlier = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("source_rank", rank.cast("int")).withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rows = rows.withColumn("level", left / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "n", "source_rank", target.alias("target"))


def mix(
    docs: DataFrame, *, key: Column | None = None, weights=WEIGHTS, share=SHARE, most=MOST_COPIES, block: int = BLOCK, fan_in: int = FAN_IN, seed: int = 0
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies and taken words; and ``key``.

    ``key`` (long) tells rows of one id apart, by default a hash of the text. Rows alike in
    id, source and key are drawn one by one, but nothing says which of them a result is.

    A null text has no words, and a document without words gets no copies. A null
    source is a source of its own, a null id an id. Repeated rows are rows of their own. A table
    without rows gives none.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            (F.xxhash64("text") if key is None else key).alias("key"),
            F.size(words(F.col("text"))).cast("long").alias("size"),
        )
        .groupBy("doc_id", "source", "key", "size")
        .count()
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("count"))))
        .withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "key", "nth"))
        .drop("count", "nth")
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = stored(targets(sources, weights, share, most))
    blocks = F.ceil(F.col("n") / block).cast("long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12).cast("long")
    source = sources.withColumnRenamed("source", "_source").drop("target", "source_size")
    drawn = (
        rows.join(
            sources.select("source_rank", F.col("source").alias("_source"), blocks.alias("_blocks"), whole.alias("whole"), F.greatest(rate - whole, F.lit(0.0)).alias("part")),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .withColumn("block", F.pmod("row", F.col("_blocks")))
        .select("row", "doc_id", "key", "size", "source_rank", "block", "whole", "part")
    )

    def ordered(frame):
        return frame.sort_values(["size", "row"], ascending=[False, True], kind="stable")

    def leaf(frame):
        frame = ordered(frame)
        part = float(frame["part"].iloc[0])
        frame["part"] = _round_block(frame["row"].tolist(), frame["size"].tolist(), part, seed)
        return frame

    def inner(frame):
        frame = ordered(frame)
        frame["part"] = _round_pairs(frame["row"].tolist(), frame["size"].tolist(), frame["part"].tolist(), seed)
        return frame

    def toss(frames: Iterator):
        for frame in frames:
            frame["part"] = [float(_uniform(seed, i) < p) for i, p in zip(frame["row"], frame["part"], strict=True)]
            yield frame

    settled, settle = [], leaf
    most_blocks = source.agg(F.max(blocks)).first()[0] or 1
    while True:
        level = stored(drawn.groupBy("source_rank", "block").applyInPandas(settle, _OPEN))
        fractional = (F.col("part") > 0) & (F.col("part") < 1)
        settled.append(level.filter(~fractional))
        drawn = level.filter(fractional)
        if most_blocks == 1:
            break
        most_blocks, settle = -(-most_blocks // fan_in), inner
        drawn = drawn.withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
    result = drawn.mapInPandas(toss, _OPEN)
    for rows in settled:
        result = result.unionByName(rows)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("part").cast("long")).otherwise(0)
    return (
        result.join(sources.select("source", "source_size", "source_rank", "target"), "source_rank")
        .withColumn("copies", copies)
        .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")
    )
