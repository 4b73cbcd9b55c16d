from __future__ import annotations

import re
import sys
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import presscan as ps
from presscan.functions import text


def folded(value: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", plain.lower()).strip()


def test_accents_are_stripped_for_every_character(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", ps.strip_accents("c").alias("o"))
    assert [r for r in rows.collect() if r["o"] != text.plain(r["c"])] == []


def test_normalisation_matches_unicode_data_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("text", ps.normalize_text("text").alias("o")).collect()
    assert [r for r in rows if r["o"] != folded(r["text"])] == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aÁñ…½ﬁ가힣™ \t\x1c　ΣİŉЖ", max_size=20), min_size=20, max_size=40))
def test_normalisation_on_random_text(evaluate, values):
    assert evaluate(ps.normalize_text("v"), values) == [folded(v) for v in values]


def test_null_and_blank_text_normalise_to_empty(evaluate):
    assert evaluate(ps.normalize_text("v"), [None, "", "  \n"]) == ["", "", ""]


MATCHES = [
    ("cancion", ("La Canción del año",), True),
    ("CANCIÓN", ("una cancion nueva",), True),
    ("cancion ano", ("La Canción del Año",), True),
    ("cancion lluvia", ("La Canción del año",), False),
    ("anci", ("La Canción",), True),  # a substring, not a word
    ("copa 2030", ("Rumbo a la Copa", "Sedes 2030"), True),
    ("", ("anything",), False),
    ("  \t", ("anything",), False),
    ("x", (None, ""), False),
    ("fin", ("ﬁnal",), True),
]


def test_keyword_matching(spark):
    rows = [(k, *texts, *[None] * (2 - len(texts))) for k, texts, _ in MATCHES]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    constants = [ps.keyword_matches(k, "a", "b") for k, _, _ in MATCHES]
    got = df.select(ps.keyword_matches(F.col("k"), "a", "b"), *constants).collect()
    assert [r[0] for r in got] == [e for _, _, e in MATCHES]
    assert [r[1 + i] for i, r in enumerate(got)] == [e for _, _, e in MATCHES]


def test_keyword_tokens(evaluate):
    assert evaluate(ps.keyword_tokens("v"), [" Él  fue\tbién ", None]) == [["el", "fue", "bien"], []]


def test_first_nonblank(spark):
    row = spark.createDataFrame([(None, "  ", " x ", "y")], "a string, b string, c string, d string")
    assert row.select(ps.first_nonblank("a", "b", "c", "d")).first()[0] == "x"
