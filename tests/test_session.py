from __future__ import annotations

import os

from presscan.session import shared_folder, stored, stored_alone


def tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {name for name in os.listdir(folder) if name.startswith("stored-")}


def test_tables_on_the_way_are_deleted(spark):
    before = tables(spark)
    outside = stored(spark.range(3))

    def make():
        first = stored(outside)
        inner = stored_alone(spark, lambda: stored(first).join(stored(spark.range(2)), "id"))
        return stored(inner).union(first)

    result = stored_alone(spark, make)
    assert sorted(r["id"] for r in result.collect()) == [0, 0, 1, 1, 2]
    assert outside.count() == 3
    assert len(tables(spark) - before) == 2
