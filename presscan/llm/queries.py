"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presscan.llm import bpe, interaction, jaccard, language_id, licenses, mixing, quality, repeats, resample, sharding, topk, toxicity, url_filter
from presscan.llm.columns import broadcast_if_few, id_bucket
from presscan.session import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fit(docs.filter(~held_out), language_id.default_vocabulary(spark))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses as a repeat of an earlier place, and a digest of what it keeps."""
    cut = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return jaccard.join_groups(_table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUALITY_COLUMNS = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules on every document."""
    return quality.judge(_table(spark, sf_dir, "documents")).select(*QUALITY_COLUMNS)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document, by bytes."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.filter(~held_out).join(broadcast_if_few(stored(labels)), "doc_id")
    scored = toxicity.score(docs, labelled)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "raw"
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of enough words, drawn towards the benchmark's words."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Fixed rules of the query.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of the five filters removes from each source."""
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_source_mixing": op2_source_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_license_scans": op7_license_scans,
    "op8_quality_rules": op8_quality_rules,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_url_filters": op12_url_filters,
    "op13_filter_interaction": op13_filter_interaction,
}

SQL = {
    "op3_suffix_dedup": repeats.repeats_sql(),
    "op6_ngram_jaccard": jaccard.groups_sql(),
    "op8_quality_rules": quality.judge_sql(),
    "op7_license_scans": licenses.scan_sql(),
    "op11_importance_resampling": resample.resample_sql(),
    "op13_filter_interaction": interaction.audit_sql(),
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), rows AS (
            SELECT vec_id, v, row_number() OVER () AS r, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS copy FROM (SELECT DISTINCT vec_id, v FROM v)
        ), parts AS (
            SELECT vec_id, r, copy, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM rows
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, c.r, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0 AND q.copy = 1
            GROUP BY ALL
        ), scores AS (
            SELECT DISTINCT query_id, vec_id, score FROM pairs
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}
