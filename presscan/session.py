"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on for right results or for the intended plan.
SESSION_CONF = {
    # Offsets are part of the value of every date string; sessions run in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Repeated JSON keys keep the last value instead of dropping the block.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Let the per-site entry budget (4000) be cut before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows of long texts go to Python few at a time: a batch is held by the JVM, and once or twice by Python.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app_name: str = "presscan", master: str | None = None, **conf: str) -> SparkSession:
    """A session carrying :data:`SESSION_CONF`; ``conf`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = SESSION_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SESSION_CONF` to a session somebody else created."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; a
    cluster session without it is an error, since a machine-local folder is
    lost with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="presscan-checkpoint-")
    context.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """A folder every executor can reach, for tables a job writes on the way."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


class _Written(threading.local):
    """Paths that the open calls of :func:`stored_alone` have seen written, per thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_WRITTEN = _Written()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    Cuts the lineage of what is used more than once: it is computed once, it
    survives the loss of executors, and joins on it are planned by the size it
    really has.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _WRITTEN.open:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, stored; the tables it stores on the way are deleted.

    They are not needed any more: what followed from them is written, so nothing is ever
    computed from them again.
    """
    paths: list[str] = []
    _WRITTEN.open.append(paths)
    try:
        result = stored(make())
        paths.pop()
    finally:
        _WRITTEN.open.pop()
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return result
