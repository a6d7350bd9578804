"""Continuous re-indexing of source trees with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import language_of
from quern.plans.indexing import Indexer, IndexStats
from quern.sources.workspace import ChangeSource, ignored, in_ignored_dir, rules_of

DEBOUNCE = "500 milliseconds"


def indexable(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether a change of this path (below its root) matters: a known extension, no ignored directory, no ignore rule."""
    return language_of(path).isNotNull() & ~in_ignored_dir(path) & ~ignored(path, rules)


def root_of(path: Column, roots: list[str]) -> Column:
    """The first root that holds a path, null if none does."""
    at = F.lit(None).cast("string")
    for root in reversed(roots):
        base = root.rstrip("/")
        at = F.when((path == base) | path.startswith(base + "/"), F.lit(root)).otherwise(at)
    return at


def relevant(events: DataFrame, roots: list[str], rules: dict[str, list[tuple[str, bool]]], path_col: str = "path") -> DataFrame:
    """Change events that matter, with root and file (the path below it); works on streams and tables."""
    found = events.withColumn("root", root_of(F.col(path_col), roots)).where("root is not null")
    found = found.withColumn("file", F.substr(F.col(path_col), F.length(F.rtrim(F.col("root"), F.lit("/"))) + 2))
    keep = F.lit(False)
    for root in roots:
        keep |= (F.col("root") == root) & indexable(F.col("file"), rules.get(root, []))
    return found.where(keep)


def debounced(events: DataFrame, gap: str = DEBOUNCE, by: tuple[str, ...] = (), time_col: str = "ts", late: str | None = None) -> DataFrame:
    """Bursts of events with less than `gap` between them: first, last (its end) and n for each of `by`."""
    stream = events.withWatermark(time_col, late) if late else events
    window = F.session_window(time_col, gap)
    return stream.groupBy(*by, window).agg(F.count("*").alias("n")).select(*by, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def watch(spark: SparkSession, indexer: Indexer, checkpoint: str, on_indexed: Callable[[IndexStats], None] | None = None, once: bool = False, interval: str = DEBOUNCE, lock=None) -> StreamingQuery:
    """Indexes the roots now and after every change that matters; stop() the query to end.

    A batch carries changed paths. Those that matter (see `relevant`; ignore rules are read anew) start an index run,
    whose diff decides what is read and parsed, so a batch that is replayed does nothing new. Batches run one at a
    time, and each holds `lock` (that of the tools, if given), so there is one writer.
    """
    spark.dataSource.register(ChangeSource)
    changes = spark.readStream.format("workspace-changes").option("roots", ",".join(map(str, indexer.roots))).load()
    roots = {str(r): r for r in indexer.roots}

    def run(batch: DataFrame, number: int) -> None:
        if relevant(batch, list(roots), {name: rules_of(r) for name, r in roots.items()}).isEmpty():
            return
        with lock or nullcontext():
            stats = indexer.index()
        if on_indexed:
            on_indexed(stats)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
