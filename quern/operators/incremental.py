"""Incremental index maintenance: what changed, and new tables from old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(candidates: DataFrame, old: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """The key columns, status (added, modified, deleted, unchanged), and the new sha256, size and mtime.

    Candidates have size, mtime and either sha256 or content. A file whose size is the same and whose mtime is
    within 0.0001 s is unchanged and keeps its hash; the new hash decides about all others. Contents are hashed
    where they are read, so only keys, sizes, times and hashes are shuffled.
    """
    fresh = F.sha2(F.col("content"), 256) if "content" in candidates.columns else F.col("sha256")
    new = candidates.select(*by, F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), fresh.alias("__sha"), F.lit(True).alias("__new"))
    both = new.join(old.select(*by, "sha256", "size", "mtime", F.lit(True).alias("__old")), list(by), "full_outer")
    same = (F.col("__size") == F.col("size")) & (F.abs(F.col("__mtime") - F.col("mtime")) < 1e-4)
    sha = F.when(F.col("__new") & F.col("__old") & same, F.col("sha256")).when(F.col("__new"), F.col("__sha"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(same | (F.col("__now") == F.col("sha256")), "unchanged").otherwise("modified")
    return both.withColumn("__now", sha).withColumn("status", status).select(*by, "status", F.col("__now").alias("sha256"), F.col("__size").alias("size"), F.col("__mtime").alias("mtime"))


def untouched(candidates: DataFrame, old: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """The keys of candidates that are unchanged by size and time alone."""
    both = candidates.select(*by, F.col("size").alias("__size"), F.col("mtime").alias("__mtime")).join(old.select(*by, "size", "mtime"), list(by))
    return both.where((F.col("__size") == F.col("size")) & (F.abs(F.col("__mtime") - F.col("mtime")) < 1e-4)).select(*by)


def has_changes(diff_: DataFrame) -> bool:
    return not diff_.where("status <> 'unchanged'").isEmpty()


def new_state(diff_: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    return diff_.where("status <> 'deleted'").select(*by, "sha256", "size", "mtime")


def stale(diff_: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    return diff_.where(F.col("status").isin("modified", "deleted")).select(*by)


def to_index(diff_: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    return diff_.where(F.col("status").isin("added", "modified")).select(*by)


def delete_files(table: DataFrame, files: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """Rows of other files. Null repos count as one repo."""
    keys = files.select(*[F.col(c).alias(f"__d_{c}") for c in by]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__d_{c}")) for c in by]
    return table.join(keys, on, "left_anti")


def rows_of_files(table: DataFrame, files: DataFrame, by: tuple[str, ...] = ("repo", "file")) -> DataFrame:
    """The rows that delete_files leaves out."""
    keys = files.select(*[F.col(c).alias(f"__d_{c}") for c in by]).distinct()
    return table.join(keys, [F.col(c).eqNullSafe(F.col(f"__d_{c}")) for c in by], "left_semi")


def delete_repo(table: DataFrame, repo: str) -> DataFrame:
    return table.where(~F.col("repo").eqNullSafe(F.lit(repo)))


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of the same key; others stay."""
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def stats(diff_: DataFrame) -> DataFrame:
    """One row: files scanned, added, modified, deleted, unchanged."""
    n = lambda s: F.count_if(F.col("status") == s)
    return diff_.agg((F.count("*") - n("deleted")).alias("scanned"), *[n(s).alias(s) for s in ("added", "modified", "deleted", "unchanged")])
