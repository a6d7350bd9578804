"""Where tables that outlive no session go."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


#: Makes an execution drop the files of its exchanges as it ends; without it they stay until the driver collects garbage.
_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _held = threading.Lock(), []


@contextlib.contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write moved between tasks leaves the disk as soon as the write is done. Threads of a session can overlap."""
    with _lock:
        if not _held:
            _held.append(spark.conf.get(_DROPS, None))
        _held.append(None)
        spark.conf.set(_DROPS, "true")
    try:
        yield
    finally:
        with _lock:
            _held.pop()
            if len(_held) == 1 and (before := _held.pop()) is not None:
                spark.conf.set(_DROPS, before)
            elif not _held:
                spark.conf.unset(_DROPS)


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or else one in the warehouse."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return f"{(at or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/quern"


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in it."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, name: str) -> str:
    """A new place in it for what a lazily returned result reads; deleted as Python exits."""
    path = fresh(spark, name)

    def clear() -> None:
        with contextlib.suppress(Exception):  # the session has ended; the owner of the shared folder clears it
            remove(spark, path)

    atexit.register(clear)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
