"""Article sinks: append-if-new CSV and an upsert table.

The two disagree on a URL seen before, by design: the CSV keeps the first row
ever written, the table the last.
"""

from __future__ import annotations

import hashlib
import random
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presscan.schema import ARTICLE_FIELDS, ARTICLE_SCHEMA
from presscan.session import stored

# Quotes are doubled, an empty field stands for NULL.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

#: Deltas a table collects before an upsert folds them into a new base.
COMPACT_AFTER = 16

#: Seconds after which a write that was begun and not finished is taken for dead.
ABANDONED_AFTER = 24 * 3600

#: Marks a row of a delta that takes its key out of the table.
REMOVED = "_removed"


def as_rows(df: DataFrame) -> DataFrame:
    return df.select(*ARTICLE_FIELDS)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a CSV folder; an empty one if nothing was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ARTICLE_SCHEMA)
    return spark.read.schema(ARTICLE_SCHEMA).options(**_CSV, multiLine="true").csv(path)


#: Folders that the keys of a CSV lie in, by hash; an append looks into those of its own keys.
KEY_BUCKETS = 16


def append_new(df: DataFrame, path: str) -> int:
    """Append rows whose URL is not stored yet; returns how many.

    Duplicates within the batch are all written; a batch with nothing new
    writes nothing. The header is repeated in every part file, which is how
    CSV folders are read. URLs are known from Parquet files in a hidden folder beside the
    parts, so the CSV itself is only read where that folder is missing or where an append did
    not come to its end.
    """
    spark = df.sparkSession
    keys, unfinished = f"{path}/_keys", f"{path}/_appending"
    bucket = F.pmod(F.xxhash64("url"), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")

    def write_keys(rows: DataFrame, mode: str) -> None:
        known = rows.where(F.col("url") != "").select("url", bucket).repartition("bucket")
        known.write.mode(mode).partitionBy("bucket").parquet(keys)

    if _exists(spark, path) and (_exists(spark, unfinished) or not _exists(spark, f"{keys}/_SUCCESS")):
        write_keys(read_csv(spark, path), "overwrite")
        _delete(spark, unfinished)
    rows = as_rows(df)
    if _exists(spark, keys):
        rows = stored(rows)
        mine = [r["bucket"] for r in rows.select(bucket).distinct().collect()]  # KEY_BUCKETS at most
        known = spark.read.schema("url string, bucket int").parquet(keys).where(F.col("bucket").isin(mine))
        rows = rows.join(known.select("url"), "url", "left_anti").select(*ARTICLE_FIELDS)
    fresh = stored(rows)
    count = fresh.count()
    if count:
        _create(spark, unfinished)
        fresh.write.mode("append").options(**_CSV, emptyValue="").csv(path)
        write_keys(fresh, "append")
        _delete(spark, unfinished)
    return count


class UpsertTable:
    """Parquet table with a key where the last write wins.

    A write adds one folder ``delta/seq=N`` and never touches older data, so
    its cost is that of the batch and readers see whole writes only (a folder
    counts once its ``_SUCCESS`` marker is there). The table numbers the writes
    itself; a number is claimed before it is written, so two writers never share
    one. A caller that may repeat a write names it, and only the same name again
    is a repeat. Reading takes the newest base and lets the few deltas after it
    win; :meth:`compact` writes a new base and deletes what it replaces, but for
    the base before it, which readers may still hold.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str | Sequence[str] = "url", schema: T.StructType | str = ARTICLE_SCHEMA
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key = [key] if isinstance(key, str) else list(key)

    def _folders(self, kind: str) -> dict[int, str]:
        """Complete folders by number."""
        found = {}
        for name in _list(self.spark, f"{self.path}/{kind}"):
            if name.startswith("seq=") and _exists(self.spark, f"{self.path}/{kind}/{name}/_SUCCESS"):
                found[_number(name)] = name
        return dict(sorted(found.items()))

    def _parts(self) -> tuple[int | None, list[int]]:
        base = max(self._folders("base"), default=None)
        return base, [s for s in self._folders("delta") if base is None or s > base]

    def read(self, until: int | None = None) -> DataFrame:
        """The rows after all writes, or after those numbered up to ``until``."""
        base, deltas = self._parts()
        deltas = [seq for seq in deltas if until is None or seq <= until]
        folders = self._folders("delta")
        layers = None
        for seq in deltas:
            rows = self.spark.read.parquet(f"{self.path}/delta/{folders[seq]}").withColumn("_seq", F.lit(seq))
            layers = rows if layers is None else layers.unionByName(rows)
        rows = None if base is None else self.spark.read.parquet(f"{self.path}/base/seq={base}")
        if layers is None:
            return self.spark.createDataFrame([], self.schema) if rows is None else rows
        latest = _last_per_key(layers, self.key, "_seq")
        current = latest.where(~F.col(REMOVED)).drop(REMOVED)
        if rows is None:
            return current
        return rows.join(latest.select(*self.key), self.key, "left_anti").select(*rows.columns).unionByName(current)

    def upsert(self, df: DataFrame, order: str, write: tuple[str, int] | None = None) -> int:
        """Insert or replace whole rows; returns the batch size, 0 for a repeat.

        ``order`` is the column whose largest value decides between rows of one key;
        it is not stored. Rows of a table have no order of their own.
        A true ``_removed`` in the batch takes the key out of the table.
        ``write`` names the write by its origin and number (a stream's query id
        and batch id): the same pair again changes nothing, whatever was written
        in between, and any other pair is a write of its own.
        """
        label = _label(*write) if write else ""
        known = [*self._folders("delta").values(), *_list(self.spark, f"{self.path}/applied")] if write else []
        if any(name.endswith(label) for name in known):
            return 0
        if REMOVED not in df.columns:
            df = df.withColumn(REMOVED, F.lit(False))
        # Rows are counted while they are written: the batch is computed once, and nothing is cached.
        seen = Observation()
        folder = f"{self.path}/delta/seq={self._claim()}{label}"
        _last_per_key(df.observe(seen, F.count(F.lit(1)).alias("n")), self.key, order).write.parquet(folder)
        size = seen.get["n"]
        if not size:
            _delete(self.spark, folder)
        if len(self._parts()[1]) >= COMPACT_AFTER:
            self.compact()
        return size

    def _claim(self) -> int:
        """The next free number: of the writers that want one at once, whoever sees another's claim leaves it.

        A claim is made before the others are looked at, so no two writers miss each other,
        also on file systems that do not create a file for one caller only.
        """
        token = uuid.uuid4().hex
        while True:
            taken = [_number(name) for kind in ("base", "delta", "claims") for name in _list(self.spark, f"{self.path}/{kind}")]
            claim = f"seq={max(taken, default=-1) + 1}.{token}"
            _create(self.spark, f"{self.path}/claims/{claim}")
            rivals = [n for n in _list(self.spark, f"{self.path}/claims") if _number(n) == _number(claim) and n != claim]
            if not rivals:
                return _number(claim)
            _delete(self.spark, f"{self.path}/claims/{claim}")
            time.sleep(random.uniform(0, 0.2))

    def _claims(self, younger_than: float) -> list[int]:
        fs, target = _filesystem(self.spark, f"{self.path}/claims")
        found = fs.listStatus(target) if fs.exists(target) else []
        since = 1000 * (time.time() - younger_than)
        return [_number(s.getPath().getName()) for s in found if s.getModificationTime() > since]

    def compact(self) -> None:
        bases = self._folders("base")
        written = self._folders("delta")
        # A write that is still going on keeps its number and those above it out of the base.
        open_ = [seq for seq in self._claims(ABANDONED_AFTER) if seq not in written and seq > max(bases, default=-1)]
        deltas = [seq for seq in self._parts()[1] if seq < min(open_, default=seq + 1)]
        if not deltas:
            return
        folded = {seq: name for seq, name in written.items() if seq <= max(deltas)}
        self.read(max(deltas)).write.mode("overwrite").parquet(f"{self.path}/base/seq={max(deltas)}")
        for name in folded.values():
            if "." in name:  # a repeat is recognised after its delta is gone
                _create(self.spark, f"{self.path}/applied/{name}")
            _delete(self.spark, f"{self.path}/delta/{name}")
        for seq, name in bases.items():
            if seq != max(bases):
                _delete(self.spark, f"{self.path}/base/{name}")
        for name in _list(self.spark, f"{self.path}/claims"):
            if _number(name) < max(deltas):
                _delete(self.spark, f"{self.path}/claims/{name}")


def _number(name: str) -> int:
    return int(name.removeprefix("seq=").partition(".")[0])


def _label(origin: str, number: int) -> str:
    return f".{hashlib.sha256(origin.encode()).hexdigest()[:16]}-{number}"


def upsert(df: DataFrame, path: str, order: str, key: str | Sequence[str] = "url") -> int:
    return UpsertTable(df.sparkSession, path, key).upsert(df, order)


def write_all(df: DataFrame, sinks: Iterable[Callable[[DataFrame], int]]) -> int:
    """Hand the same rows to every sink in turn; returns the batch size. They are computed once, into a table."""
    rows = stored(df)
    for sink in sinks:
        sink(rows)
    return rows.count()


def save_articles(
    df: DataFrame, output: str, order: str = "position", base_name: str = "articles", formats: Iterable[str] = ("csv", "table")
) -> int:
    """Write ``df`` in the chosen formats under ``output``.

    ``order`` is the column that places the rows of the batch, as :func:`search_many` adds on
    request: of rows of one URL the table keeps the last.
    """
    available = {
        "csv": lambda rows: append_new(rows, f"{output}/{base_name}.csv"),
        "table": lambda rows: upsert(rows.select(*ARTICLE_FIELDS, order), f"{output}/{base_name}.table", order),
    }
    chosen = list(formats)
    unknown = [f for f in chosen if f not in available]
    if unknown or not chosen:
        raise ValueError(f"formats must be among {', '.join(available)}")
    return write_all(df, [available[f] for f in chosen])


def _last_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of every key; combined map-side, whole rows incl. NULLs."""
    rest = [c for c in df.columns if c not in (*key, order)]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    kept = [c for c in df.columns if c != order]
    return last.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in kept])


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def _list(spark: SparkSession, path: str) -> list[str]:
    fs, target = _filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written folders ``batch=N``."""
    names = [n for n in _list(spark, path) if n.startswith("batch=")]
    return sorted(int(n.removeprefix("batch=")) for n in names if _exists(spark, f"{path}/{n}/_SUCCESS"))


def _create(spark: SparkSession, path: str) -> bool:
    """Whether this call created the empty file."""
    fs, target = _filesystem(spark, path)
    return fs.createNewFile(target)


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)
