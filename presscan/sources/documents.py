"""Scans over the table of already-fetched web documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presscan.schema import DOCUMENT_SCHEMA, KIND_PAGE, RETRIES


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(DOCUMENT_SCHEMA).load(path)


def usable_documents(documents: DataFrame, kind: str | None = None) -> DataFrame:
    """Text resources; the body of an answer that was not OK reads as NULL."""
    if kind is not None:
        documents = documents.where(F.col("kind") == kind)
    ok = F.col("status").between(200, 299)
    return documents.withColumn("body", F.when(ok, F.col("body")))


def article_pages(documents: DataFrame) -> DataFrame:
    """Article pages; the status is not looked at, error pages count too."""
    return documents.where(F.col("kind") == KIND_PAGE)


def first_success(
    attempts: DataFrame,
    retries: int = RETRIES,
    key: str = "url",
    order: str = "attempt",
    value: str = "body",
) -> DataFrame:
    """Per key, the first of ``retries + 1`` attempts that has a value.

    ``min_by`` combines map-side, so a key with very many attempts sends one
    row per map task and never meets in one place as a whole.
    """
    rest = [c for c in attempts.columns if c != key]
    tried = attempts.where((F.col(order) <= retries + 1) & F.col(value).isNotNull())
    return first_per_key(tried, [key], [F.col(order)], rest)


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column], rest: list[str] | None = None
) -> DataFrame:
    """One row per key: the one that comes first in ``order``."""
    rest = [c for c in df.columns if c not in keys] if rest is None else rest
    row = F.struct(*rest)
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])
