"""Sharding by a k-d tree over document metadata.

A node that is to yield ``k`` shards is split at the weighted median (the
quantile of bytes that the first ``k // 2`` of them have room for) of its widest dimension, until every leaf
holds the bytes of one shard. Dimensions are derived from the text alone, so
equal texts are one point and stay in one shard. A point heavier than a twentieth of a shard would
make the halves uneven: such groups of copies, of which there are at most twenty a shard, get their
shards first, the heaviest where most room is left, and the tree fills the rest evenly. Only a group
of copies above a whole shard is cut.

Medians are exact and distributed: points are range-partitioned by node and
coordinate, and a point's position is the sum of the partitions before it plus a
running sum inside its own partition. Only per-node bounds (one row a shard at
most) reach the driver.
"""

from __future__ import annotations

import heapq
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presscan.llm.columns import bytes_of, partitions
from presscan.session import stored

#: Bytes that every document costs besides its text.
OVERHEAD = 16
#: Points above this share of a shard get their shard ahead of the tree; groups above a shard are cut into such pieces.
PIECE = 0.05
DIMENSIONS = ("size", "text_crc32", "n_points")
_POINT = ("text_crc32", "size", "n_points", "piece")


def _positions(rows: DataFrame, node: str, order: list[str], weight: Column) -> DataFrame:
    """``before``: the summed ``weight`` of a node's rows that come earlier in ``order``.

    Rows are written range-partitioned, so that partition numbers stay what they are.
    """
    spread = rows.repartitionByRange(partitions(rows.sparkSession), node, *order)
    spread = stored(spread.withColumn("part", F.spark_partition_id()))
    part = Window.partitionBy(node).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(node, "part")
        .agg(F.sum(weight).alias("part_weight"))
        .select(node, "part", F.coalesce(F.sum("part_weight").over(part), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy(node, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = spread.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return running.join(offsets, [node, "part"]).withColumn("before", F.col("offset") + F.col("inside"))


def _by_node(values: dict[int, int]) -> Column:
    """A literal map from a node's first shard to a value; at most one entry a shard."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col("first"))


def _roomiest(heavy: list[int], shards: int, target: float) -> tuple[list[int], list[float]]:
    """A shard for each of the weights, which fall, and the room that is left in every shard."""
    free = [(-target, shard) for shard in range(shards)]
    chosen = []
    for weight in heavy:
        room, shard = heapq.heappop(free)
        heapq.heappush(free, (room + weight, shard))
        chosen.append(shard)
    room = dict((shard, max(-left, 0.0)) for left, shard in free)
    return chosen, [room[shard] for shard in range(shards)]


def kd_shards(points: DataFrame, room: list[float]) -> DataFrame:
    """``points`` (coordinates :data:`DIMENSIONS`, ``piece``, ``weight``) with the column ``shard``; shards fill as far as they have ``room``."""
    tree = points.withColumns({"first": F.lit(0), "k": F.lit(len(room))})
    whole: dict[str, int] = {}
    while True:
        bounds = (
            tree.groupBy("first", "k")
            .agg(
                F.sum("weight").alias("weight"),
                *[F.min(d).alias(f"min_{d}") for d in DIMENSIONS],
                *[F.max(d).alias(f"max_{d}") for d in DIMENSIONS],
            )
            .collect()
        )
        if all(b["k"] == 1 for b in bounds):
            return tree.select(*_POINT, F.col("first").alias("shard"))
        width = {b["first"]: {d: b[f"max_{d}"] - b[f"min_{d}"] for d in DIMENSIONS} for b in bounds}
        whole = whole or width[0]
        widest = {
            node: max(range(len(DIMENSIONS)), key=lambda i: (w[DIMENSIONS[i]] / max(whole[DIMENSIONS[i]], 1), -i))
            for node, w in width.items()
        }
        left = {}
        for b in bounds:
            halves = room[b["first"] : b["first"] + b["k"] // 2], room[b["first"] + b["k"] // 2 : b["first"] + b["k"]]
            both = sum(map(sum, halves))
            left[b["first"]] = b["weight"] * (sum(halves[0]) / both if both else (b["k"] // 2) / b["k"])
        coordinate = F.element_at(F.array(*[F.col(d).cast("long") for d in DIMENSIONS]), _by_node(widest) + 1)
        placed = _positions(tree.withColumn("at", coordinate), "first", ["at", *_POINT], F.col("weight"))
        half = F.floor(F.col("k") / 2).cast("int")
        stays = (F.col("k") == 1) | (F.col("before") + F.col("weight") / 2 < _by_node(left))
        tree = placed.select(
            *_POINT,
            "weight",
            F.when(stays, F.col("first")).otherwise(F.col("first") + half).alias("first"),
            F.when(F.col("k") == 1, F.col("k")).when(stays, half).otherwise(F.col("k") - half).alias("k"),
        )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: its shard and a gapless slot inside it.

    Columns: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard
    (null under this law). A null text counts as empty. Repeated rows are rows of
    their own. A table without rows gives none; fewer points than shards leave
    shards empty.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(F.coalesce("text", F.lit(""))) + OVERHEAD).cast("long").alias("size"),
            F.crc32(bytes_of(F.col("text"))).alias("text_crc32"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    target = max((rows.agg(F.sum("size")).first()[0] or 0) / shards, 1)
    text = ["text_crc32", "size", "n_points"]
    groups = rows.groupBy(*text).agg(F.sum("size").alias("bytes"))
    # Each of these holds a twentieth of a shard at least: there are at most 20 a shard.
    heavy = sorted(groups.filter(F.col("bytes") > target * PIECE).collect(), key=lambda g: (-g["bytes"], *(g[c] for c in text)))
    whole = [g for g in heavy if g["bytes"] <= target]
    chosen, room = _roomiest([g["bytes"] for g in whole], shards, target)
    known = [(*(g[c] for c in text), None, shard) for g, shard in zip(whole, chosen, strict=True)]
    known += [(*(g[c] for c in text), ceil(g["bytes"] / (target * PIECE)), None) for g in heavy if g["bytes"] > target]
    heavy = docs.sparkSession.createDataFrame(known, "text_crc32 long, size long, n_points long, pieces long, given int")
    # Copies of a text above a shard are dealt out by id; those without one, or of one id, by their place in the table.
    dealt = F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces"))
    rows = rows.join(F.broadcast(heavy), text, "left").withColumn("piece", F.coalesce(dealt, F.lit(0))).drop("pieces")
    points = stored(rows.filter("given IS NULL").groupBy(*_POINT).agg(F.sum("size").alias("weight")))
    tree = rows.filter("given IS NULL").drop("given").join(kd_shards(points, room), list(_POINT))
    sharded = tree.unionByName(rows.filter("given IS NOT NULL").withColumnRenamed("given", "shard"))
    placed = _positions(sharded, "shard", ["doc_id", *_POINT, "row"], F.lit(1))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("before").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
