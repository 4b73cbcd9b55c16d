from __future__ import annotations

import shutil

import pytest

import presscan as ps
from presscan import sinks
from presscan.sinks import COMPACT_AFTER


@pytest.fixture
def batch(spark):
    def make(*rows: tuple[str, str | None]):
        full = [("a", title, 'line\n"two", three', "Redacción ", None, "", url, "k", "s", i) for i, (url, title) in enumerate(rows)]
        return spark.createDataFrame(full, ", ".join(f"{name} string" for name in ps.ARTICLE_FIELDS) + ", position int")

    return make


def stored_titles(df):
    return sorted((r["url"], r["title"]) for r in df.collect())


def test_append_keeps_what_was_written_first(spark, batch, tmp_path):
    path = str(tmp_path / "out.csv")
    assert ps.append_new(batch(), path) == 0
    assert not (tmp_path / "out.csv").exists()
    assert ps.append_new(batch(("u1", "old"), ("u1", "twice")), path) == 2
    assert ps.append_new(batch(("u1", "new"), ("u2", None)), path) == 1
    assert ps.append_new(batch(("u1", "newer")), path) == 0
    rows = ps.read_csv(spark, path)
    assert sorted(map(tuple, rows.select("url", "title").collect()), key=repr) == [("u1", "old"), ("u1", "twice"), ("u2", None)]
    first = rows.where("url = 'u2'").first()
    assert (first["description"], first["author"], first["image_url"]) == ('line\n"two", three', "Redacción ", None)


def test_upsert_replaces_whole_rows(spark, batch, tmp_path):
    path = str(tmp_path / "table")
    table = ps.UpsertTable(spark, path)
    assert table.read().count() == 0
    assert ps.upsert(batch(("u1", "old"), ("u2", "kept")), path, "position") == 2
    assert ps.upsert(batch(("u1", "lost"), ("u1", None)).coalesce(1), path, "position") == 2
    assert sorted(map(tuple, table.read().select("url", "title").collect())) == [("u1", None), ("u2", "kept")]
    table.compact()
    assert ps.upsert(batch(("u3", "after")), path, "position") == 1
    assert table.read().columns == list(ps.ARTICLE_FIELDS)
    assert table.read().count() == 3


def test_repeated_and_many_writes(spark, batch, tmp_path):
    table = ps.UpsertTable(spark, str(tmp_path / "table"))
    for seq in range(COMPACT_AFTER + 2):
        table.upsert(batch(("u", f"v{seq}"), (f"u{seq}", "x")), "position", write=("q", seq))
    assert table._parts() == (COMPACT_AFTER - 1, [COMPACT_AFTER, COMPACT_AFTER + 1])
    assert table.upsert(batch(("u", "replayed")), "position", write=("q", 3)) == 0
    assert dict(stored_titles(table.read()))["u"] == f"v{COMPACT_AFTER + 1}"
    assert table.read().count() == COMPACT_AFTER + 3
    # The same number of another origin is a write of its own, and older folders are gone.
    assert table.upsert(batch(("other", "new")), "position", write=("another", 3)) == 1
    assert table.read().count() == COMPACT_AFTER + 4
    assert len(list((tmp_path / "table" / "delta").iterdir())) == 3


def test_saved_articles_keep_the_last_row(spark, batch, tmp_path):
    rows = batch(*[("u", f"t{i}") for i in range(20)])
    for n in (1, 7):
        assert ps.save_articles(rows.repartition(n), str(tmp_path), base_name=f"n{n}", formats=["table"]) == 20
        assert [r["title"] for r in ps.UpsertTable(spark, str(tmp_path / f"n{n}.table")).read().collect()] == ["t19"]


def test_appends_do_not_read_the_csv(spark, batch, tmp_path, monkeypatch):
    path = str(tmp_path / "out.csv")
    assert ps.append_new(batch(("u1", "a"), ("u2", "b")), path) == 2
    monkeypatch.setattr(sinks, "read_csv", None)
    assert ps.append_new(batch(("u2", "x"), ("u3", "c")), path) == 1
    monkeypatch.undo()
    # An append that did not come to its end, and a folder without keys: the CSV tells.
    (tmp_path / "out.csv" / "_appending").touch()
    shutil.rmtree(tmp_path / "out.csv" / "_keys")
    assert ps.append_new(batch(("u1", "y"), ("u4", "d")), path) == 1
    assert stored_titles(ps.read_csv(spark, path)) == [("u1", "a"), ("u2", "b"), ("u3", "c"), ("u4", "d")]


def test_two_writers_keep_both_batches(spark, batch, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    tables = [ps.UpsertTable(spark, str(tmp_path / "table")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda t: t[1].upsert(batch((f"u{t[0]}", "x"), ("all", f"v{t[0]}")), "position"), enumerate(tables)))
    assert {u for u, _ in stored_titles(tables[0].read())} == {"all", "u0", "u1", "u2", "u3"}


def test_a_batch_is_computed_once(spark, batch, tmp_path):
    """Rows of a batch that cannot be computed twice alike are the same in every format."""
    from pyspark.sql import functions as F

    drawn = batch(*[(f"u{i}", "x") for i in range(50)]).withColumn("title", F.uuid())
    ps.save_articles(drawn, str(tmp_path), base_name="once")
    csv, table = ps.read_csv(spark, str(tmp_path / "once.csv")), ps.UpsertTable(spark, str(tmp_path / "once.table")).read()
    assert stored_titles(csv) == stored_titles(table)


def test_removal_marks(spark, batch, tmp_path):
    from pyspark.sql import functions as F

    table = ps.UpsertTable(spark, str(tmp_path / "table"))
    table.upsert(batch(("u", "v"), ("w", "x")), "position")
    table.compact()
    table.upsert(batch(("u", "v")).withColumn("_removed", F.lit(True)), "position")
    assert stored_titles(table.read()) == [("w", "x")]
    table.compact()
    assert stored_titles(table.read()) == [("w", "x")]


def test_a_half_written_batch_is_not_seen(spark, batch, tmp_path):
    table = ps.UpsertTable(spark, str(tmp_path / "table"))
    table.upsert(batch(("u", "v")), "position")
    table.upsert(batch(("u", "broken")), "position")
    (tmp_path / "table" / "delta" / "seq=1" / "_SUCCESS").unlink()
    assert stored_titles(table.read()) == [("u", "v")]


def test_fan_out(spark, batch, tmp_path):
    rows = batch(("u1", "a"), ("u2", "b"))
    for _ in range(2):
        assert ps.save_articles(rows, str(tmp_path), base_name="news") == 2
    assert ps.read_csv(spark, str(tmp_path / "news.csv")).count() == 2
    assert ps.UpsertTable(spark, str(tmp_path / "news.table")).read().count() == 2
    assert ps.save_articles(rows, str(tmp_path), base_name="only", formats=["csv"]) == 2
    assert not (tmp_path / "only.table").exists()
    with pytest.raises(ValueError):
        ps.save_articles(rows, str(tmp_path), formats=["sqlite3"])
