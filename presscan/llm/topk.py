"""Exact top-k by inner product with a pivot table.

The distances of every vector to a fixed number of pivots are computed once and
kept beside it. Together they say where a vector lies in the span of the pivots and how far
off it, which bounds the distance of a query and a candidate from below: by their distance inside
the span and the difference of their distances off it. No lower bound that follows from the
table is larger; it bounds their inner product from above. A task evaluates its candidates in the order of that bound and stops
for a query as soon as no bound left reaches the query's k-th best score.

Queries are answered in blocks of a fixed number against all rows, a job each; only one block
and the pivots, both of bounded size, are ever broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presscan.session import shared_folder, stored

K = 10
SCALE = 1024
PIVOTS = 48
QUERY_BLOCK = 4096
#: Queries whose bounds a task holds at once, and candidates evaluated between two looks at the bounds.
TILE, STEP = 128, 256
_EXACT = float(1 << 53)


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v`` = floor(scale * x); vectors that are null or hold null or non-finite components go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    parts = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    usable = F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull()
    return embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column; short vectors are filled with zeros, which change no product or distance."""
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten())
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    ends = np.cumsum(lengths)
    for i, (n, end) in enumerate(zip(lengths, ends, strict=True)):
        out[i, :n] = values[end - n : end]
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best by score, ties to smaller ids, each pair once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return ids[new][:k], scores[new][:k]


@dataclass(frozen=True)
class _Pivots:
    """Pivots, and what turns products with them into coordinates of an orthonormal basis of their span."""

    centres: np.ndarray
    squares: np.ndarray
    basis: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray) -> _Pivots:
        left, size, _ = np.linalg.svd(centres, full_matrices=False) if centres.size else (np.zeros((len(centres), 0)), np.zeros(0), None)
        some = size > 1e-9 * size.max(initial=0)
        return cls(centres, (centres * centres).sum(1), left[:, some] / size[some])

    def placed(self, distances: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in the span and distance off it of vectors with these distances to the pivots and squared norms."""
        products = (self.squares[None, :] + squares[:, None] - distances * distances) / 2
        inside = products @ self.basis
        return inside, np.sqrt(np.maximum(squares - (inside * inside).sum(1), 0.0))


def _search(batches: Iterator[pa.RecordBatch], queries, pivots, width: int, k: int, evaluated) -> Iterator[pa.RecordBatch]:
    ids, integers, near = queries.value
    exact = np.abs(integers).max(initial=0)
    query = integers.astype(np.float64)
    norms = (query * query).sum(1)
    inside, off = pivots.value.placed(near, norms)
    best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own, wide = np.asarray(batch.column("vec_id")), _matrix(batch.column("v"), width)
        table = np.asarray(batch.column("pivot_distances").flatten()).reshape(batch.num_rows, -1)
        rows = wide.astype(np.float64)
        squares = (rows * rows).sum(1)
        own_inside, own_off = pivots.value.placed(table, squares)
        small = float(np.abs(wide).max(initial=0)) * float(exact) * max(width, 1) < _EXACT
        for start in range(0, len(ids), TILE):
            tile = slice(start, start + TILE)
            # Half of both squared norms less the lower bound of the squared distance.
            upper = inside[tile] @ own_inside.T + off[tile, None] * own_off[None, :]
            upper += 1e-6 * (norms[tile, None] + squares[None, :]) + 1  # what rounding may have taken off
            for j, bound in enumerate(upper):
                q = start + j
                found, scores = best[q]
                order = np.argsort(-bound, kind="stable")
                for at in range(0, len(order), STEP):
                    some = order[at : at + STEP]
                    if len(scores) == k and bound[some[0]] < scores[-1]:
                        break
                    some = some[own[some] != ids[q]]
                    count += len(some)
                    product = np.rint(rows[some] @ query[q]).astype(np.int64) if small else wide[some] @ integers[q]
                    found, scores = _merge(np.concatenate([found, own[some]]), np.concatenate([scores, product]), k)
                best[q] = found, scores
    if evaluated is not None:
        evaluated.add(count)
    counts = [len(found) for found, _ in best]
    if sum(counts):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, counts)),
                pa.array(np.concatenate([f for f, _ in best])),
                pa.array(np.concatenate([s for _, s in best])),
            ],
            ["query_id", "vec_id", "score"],
        )


def top_k(
    vectors: DataFrame, queries: DataFrame, *, k: int = K, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, evaluated: Accumulator | None = None
) -> DataFrame:
    """The ``k`` vectors of highest inner product for each query, without the query's own id.

    Both tables have vec_id and ``v`` (integers). Ties go to the smaller id. Rows
    repeated with the same id and score count once; of a query id that is repeated the
    smallest vector is asked. Without queries or vectors there are no rows. ``evaluated``
    counts the pairs that the bounds leave to be evaluated.
    """
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centres = np.zeros((len(chosen), width))
    for i, row in enumerate(chosen):
        centres[i, : len(row["v"])] = row["v"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_matrix(batch.column("v"), width).astype(np.float64), centres)
            offsets = pa.array(np.arange(0, far.size + 1, max(far.shape[1], 1), dtype=np.int32)[: len(far) + 1])
            yield batch.append_column("pivot_distances", pa.ListArray.from_arrays(offsets, pa.array(far.ravel())))

    with_distances = "vec_id long, v array<long>, pivot_distances array<double>"
    table = stored(vectors.mapInArrow(measure, with_distances))
    span = spark.sparkContext.broadcast(_Pivots.of(centres))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = -(-asked.count() // query_block)
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))))
    schema, answers = "query_id long, vec_id long, score long", f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(answers)
    for b in range(blocks):
        rows = asked.filter(F.col("block") == b).orderBy("vec_id").collect()
        integers = np.zeros((len(rows), width), np.int64)
        for i, row in enumerate(rows):
            integers[i, : len(row["v"])] = row["v"]
        ids = np.array([row["vec_id"] for row in rows], np.int64)
        block = spark.sparkContext.broadcast((ids, integers, _distances(integers.astype(np.float64), centres)))
        best = table.mapInArrow(lambda batches, block=block: _search(batches, block, span, width, k, evaluated), schema)
        best.write.mode("append").parquet(answers)
        block.unpersist()
    found = spark.read.schema(schema).parquet(answers)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
