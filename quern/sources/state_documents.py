"""State documents of an index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schema import STATE


def import_state(spark: SparkSession, text: str, repo: str = "") -> DataFrame:
    """A state document {"version": 1, "files": {path: {sha256, size, mtime}}} as rows; malformed entries are dropped."""
    rows = spark.createDataFrame([(text,)], "j string").select(F.from_json(F.get_json_object("j", "$.files"), "map<string, string>").alias("s"))
    part = lambda name, kind: F.get_json_object("m", f"$.{name}").try_cast(kind)
    files = rows.select(F.explode("s").alias("file", "m")).select("file", part("sha256", "string").alias("sha256"), part("size", "long").alias("size"), part("mtime", "double").alias("mtime"))
    return files.dropna().select(F.lit(repo).alias("repo"), "file", "sha256", "size", "mtime").to(spark.createDataFrame([], STATE).schema)


def export_state(state: DataFrame) -> str:
    """The state of one repo as such a document, keys sorted."""
    files = {r["file"]: {"sha256": r["sha256"], "size": r["size"], "mtime": r["mtime"]} for r in state.orderBy("file").collect()}
    return json.dumps({"version": 1, "files": files}, sort_keys=True, indent=2)
