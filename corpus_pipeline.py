"""A training corpus from raw documents to tokens.

Five stages, each an operator of ``presscan.llm``: documents without letters go,
one document of every group of near copies stays, repeated passages are cut out,
sources are mixed to target weights (documents come as often as they are taken), and
what is left is encoded. Every stage is written as a table and read again as the
next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presscan.llm import bpe, jaccard, language_id, mixing, repeats
from presscan.llm.columns import KEY, broadcast_if_few, with_row_keys
from presscan.session import configure, stored, stored_alone

#: Posterior of the best learned language below which a document goes. It is next to 1 for all but the
#: shortest texts, also in a language that was not learned, so in effect only texts without letters go.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters. One in a language that was not learned counts as the likeliest learned one and stays."""
    model = language_id.fit(docs, language_id.default_vocabulary(spark))
    labelled = language_id.annotate(docs, model)
    rejected = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_SCORE)
    return labelled.filter(~rejected).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that shingle links connect; rows without an id stay.

    Rows that repeat an id are documents of their own, and go only if a link shows them to be near
    copies of one that stays. Of rows alike in id and text one stays.
    """
    keyed, shift = with_row_keys(docs)
    groups = jaccard.keyed_groups(docs)
    goes = stored(groups.filter(F.col(KEY) != F.col("__first")).select(F.col(KEY).alias("__gone")).distinct())
    kept = keyed.join(broadcast_if_few(goes), F.col(KEY) == F.col("__gone"), "left_anti")
    if shift:  # equal ids and texts share a key
        kept = kept.filter(F.col(KEY).isNotNull()).dropDuplicates([KEY]).unionByName(kept.filter(F.col(KEY).isNull()))
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier place; n_chars follows the text."""
    cut = repeats.deduplicated(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Rows without an id, and rows that repeat one, are documents of their own with their own
    copies. Rows alike in all columns share what is taken of them. Rows of one id (or
    without) are told apart by a 64-bit hash of all columns.
    """
    key = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    drawn = mixing.mix(docs, key=key).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    taken = drawn.agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__alike"))
    taken = stored(taken.filter("__copies > 0"))

    def rows(of: DataFrame) -> DataFrame:
        return docs.withColumn("__row", key).join(of, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key")))

    found = rows(taken.filter("__alike = 1"))
    alike = taken.filter("__alike > 1")
    if not alike.isEmpty():
        found = found.unionByName(rows(alike).dropDuplicates(["__id", "__key"]))
    times = F.array_repeat(F.lit(1), F.col("__copies").cast("int"))
    return found.withColumn("__time", F.explode(times)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and copy, with digests of the ids and of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


def _configured(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` with the library's settings, so that it can run alone."""
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES = [
    ("language_id", _configured(known_language)),
    ("ngram_jaccard", _configured(one_of_each_group)),
    ("suffix_dedup", _configured(cut_repeats)),
    ("source_mixing", _configured(mix_sources)),
    ("byte_bpe", _configured(encode)),
]
#: SQL has no forward algorithm, components or dependent rounding; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
