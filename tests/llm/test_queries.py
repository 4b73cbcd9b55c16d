"""The registered queries on the smallest tables: columns of the contracts, hold-outs, and digests by plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_exact_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_quality_rules": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    "op9_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op13_filter_interaction": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "shapley": "bigint"},
}


@pytest.fixture(scope="module")
def answers(spark):
    """Rows of each query by name, run once."""
    known = {}

    def rows(name):
        if name not in known:
            df = entry.queries()[name](spark, SF_DIR)
            known[name] = (dict(df.dtypes), df.collect())
        return known[name]

    return rows


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(answers, documents, name):
    types, rows = answers(name)
    expected = COLUMNS[name]
    assert {c: types[c] for c in expected} == expected
    if name != "op13_filter_interaction":
        assert list(types)[: len(expected)] == list(expected)
    if "doc_id" in expected:
        assert sorted(r["doc_id"] for r in rows) == sorted(documents)


def test_languages_held_out(answers, documents):
    rows = answers("op1_language_id")[1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    asked = [r for r in rows if r["held_out"] and documents[r["doc_id"]]["lang"] and re.search("[a-z]", documents[r["doc_id"]]["text"] or "")]
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in asked) >= 0.95 * len(asked) > 0


def test_mix_nears_its_targets(answers):
    rows = answers("op2_source_mixing")[1]
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        of = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= max(r["size"] for r in of)


def test_digests(answers, documents):
    texts = {i: (r["text"] or "").encode() for i, r in documents.items()}
    for r in answers("op4_byte_bpe")[1]:
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]).hexdigest()
    for r in answers("op3_suffix_dedup")[1]:
        assert r["n_bytes"] == len(texts[r["doc_id"]])
        if not r["n_removed"]:
            assert r["kept_sha256"] == hashlib.sha256(texts[r["doc_id"]]).hexdigest()
    assert any(r["n_removed"] for r in answers("op3_suffix_dedup")[1])


def test_groups_and_shards(answers, documents):
    groups = {r["doc_id"]: r["component_id"] for r in answers("op6_ngram_jaccard")[1]}
    assert all(c <= i and groups[c] == c for i, c in groups.items())
    sharded = answers("op9_sharding")[1]
    assert {r["shard"] for r in sharded} <= set(range(40))
    assert all(r["text_crc32"] == zlib.crc32((documents[r["doc_id"]]["text"] or "").encode()) for r in sharded)


def test_toxicity_held_out(answers, spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = answers("op10_toxicity")[1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    asked = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in asked) >= 0.8 * len(asked) > 0


def test_quality_verdict(answers):
    for r in answers("op8_quality_rules")[1]:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
