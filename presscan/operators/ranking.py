"""Ordered operators that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presscan.session import stored
from presscan.sources.documents import first_per_key

_SALTS = 64


def keep_first(df: DataFrame, key: str = "url", order: tuple[str, ...] = ("site_ord", "path", "entry_ord")) -> DataFrame:
    """Distinct on ``key``, keeping the row that comes first in ``order``.

    Combined map-side: a key with very many copies ships one row per map task.
    """
    return first_per_key(df, [key], [F.col(c) for c in order])


def top_n_per_group(
    df: DataFrame, group: list[str], order: list[Column | str], n: int, salts: int = _SALTS, rank: str = "_rn"
) -> DataFrame:
    """The first ``n`` rows of every group, numbered from 1 in ``rank``.

    The first ``n`` of a group are among the first ``n`` of each of its salted
    parts, so a group is ranked in ``salts`` tasks first and only ``n * salts``
    of its rows meet in the second ranking, however large the group is.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_cols), F.lit(salts)).cast("int"))
    part = Window.partitionBy(*group, "_salt").orderBy(*order_cols)
    whole = Window.partitionBy(*group).orderBy(*order_cols)
    kept = salted.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= n).drop("_salt", rank)
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)


def limit_scan(
    entries: DataFrame, n: int, group: str = "site_ord", order: tuple[str, ...] = ("path", "entry_ord")
) -> DataFrame:
    """Only the first ``n`` entries of every site are examined."""
    return top_n_per_group(entries, [group], list(order), n).drop("_rn")


def limit_leaves(leaves: DataFrame, n: int) -> DataFrame:
    """The per-site entry budget, spent on documents instead of entries.

    Adds ``take``, the number of entries wanted from each url-set. Of a large site only the
    ranges that the budget reaches are added up row by row.
    """
    counted = _running(leaves.where(F.col("n_entries") > 0), ["site_ord"], ["path"], "n_entries", until=n)
    left = counted.withColumn("_left", F.lit(n) - F.col("_before")).where(F.col("_left") > 0)
    return left.withColumn("take", F.least("_left", "n_entries")).drop("_left", "_before")


def _running(df: DataFrame, group: list[str], order: list[str], weight: Column | str, until: int | None = None) -> DataFrame:
    """``df`` with ``_before``, the weight of the rows of its group that come earlier, for groups of any size.

    Rows are range-partitioned by (group, order), so a large group spans many
    partitions and lies in them in order. What is before a row is what is before it in its
    partition plus the group's weight in earlier partitions. Partitions that begin at ``until`` or
    later are left out. The partitioned rows are stored once, with their partition
    number: sampled range bounds may differ between two runs of the same stage.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    ranged = df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(*[F.col(c) for c in (*group, *order)])
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "_part").agg(F.sum("_weight").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    if until is not None:
        offsets = offsets.where(F.col("_offset") < until)
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reached = ranged.join(offsets, [*group, "_part"])
    before = F.col("_offset") + F.coalesce(F.sum("_weight").over(local), F.lit(0))
    return reached.withColumn("_before", before).drop("_part", "_offset", "_weight").select(*df.columns, "_before")


def row_number_all(df: DataFrame, group: list[str], order: list[str], rank: str = "_rn") -> DataFrame:
    """Number every row of every group, for groups of any size."""
    return _running(df, group, order, F.lit(1)).withColumn(rank, F.col("_before") + 1).drop("_before")


def interleave(
    df: DataFrame,
    group: str = "site_key",
    order: tuple[str, ...] = ("site_ord", "path", "entry_ord"),
    limit: int | None = None,
    per: tuple[str, ...] = (),
) -> DataFrame:
    """Round-robin over groups, so that a cap stays fair.

    Groups take turns in the order of their first appearance and keep their
    inner order. ``limit`` cuts the interleaved list; with ``per`` there is one
    list for every value of those columns. Adds ``turn``, the round from 1.
    """
    keys = [*per, group]
    position = [F.col("turn"), F.col("_first")]
    if limit is None:
        ranked = row_number_all(df, keys, list(order), "turn")
        first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
        return ranked.join(first, keys).orderBy(*per, *position).drop("_first")
    ranked = top_n_per_group(df, keys, list(order), limit, rank="turn")
    # At most ``limit`` rows are left of a group, partitioned and sorted already.
    same = Window.partitionBy(*keys).orderBy(*order)
    lined_up = ranked.withColumn("_first", F.first(F.struct(*order)).over(same))
    if not per:
        return lined_up.orderBy(*position).limit(limit).drop("_first")
    return top_n_per_group(lined_up, list(per), position, limit, rank="_rn").drop("_rn", "_first")
