"""The four tools: index a workspace, search it, find usages and definitions; answers are dictionaries or JSON."""

from __future__ import annotations

import json
import threading
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import navigation
from quern.operators.extract import extract_blocks, extract_calls
from quern.operators.models import Encoder, Scorer
from quern.plans.indexing import Indexer
from quern.plans.search import Searcher, snippets
from quern.schema import DEFINITION_LIMIT, SEARCH_LIMIT, USAGE_LIMIT
from quern.sources.workspace import read_workspace, resolve_roots

FOLDER = ".quern"


def _rows(df: DataFrame) -> list[dict]:
    """Rows as dictionaries, null fields left out."""
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]


class Workspace:
    """Tools over one or several roots. The index is in `path`, by default a folder of the first root.

    approximate: semantic searches go by a stored index of the vectors, made anew by runs that change something.
    """

    def __init__(self, spark: SparkSession, roots=None, path: str | None = None, encoder: Encoder | None = None, scorer: Scorer | None = None, precision: str = "float32", approximate: bool = False):
        self.spark, self.roots, self.scorer, self.approximate = spark, resolve_roots(roots), scorer, approximate
        self.indexer = Indexer(spark, path or f"file://{self.roots[0] / FOLDER}", self.roots, encoder, precision)
        self.lock = threading.Lock()  # one tool at a time

    def files(self) -> DataFrame:
        order = F.lit(0)
        for i, r in enumerate(self.roots):
            order = F.when(F.col("repo") == r.name, i).otherwise(order)
        return read_workspace(self.spark, self.roots).withColumn("root_order", order)

    def index_workspace(self) -> dict:
        missing = [r for r in self.roots if not Path(r).is_dir()]
        if len(missing) == len(self.roots):
            return {"status": "error", "message": f"no such directory: {', '.join(map(str, missing))}"}
        with self.lock:
            s = self.indexer.index()
            if self.approximate and (s.chunks or s.modified or s.deleted):
                self.indexer.index_vectors()
        out = {"status": "success", "files_scanned": s.scanned, "files_added": s.added, "files_modified": s.modified, "files_deleted": s.deleted, "chunks_indexed": s.chunks, "total_chunks": s.total}
        return out | ({"workspaces": s.workspaces} if len(self.roots) > 1 else {})

    def semantic_search(self, query: str, limit: int = SEARCH_LIMIT, mode: str = "hybrid", rerank: bool = False, repo: str | None = None) -> list[dict]:
        with self.lock:
            found = Searcher(self.indexer, self.files(), self.scorer, self.approximate).search(query, limit, mode, rerank, repo)
            return _rows(found.drop("rank", "id"))

    def find_usages(self, symbol: str, limit: int = USAGE_LIMIT, repo: str | None = None) -> list[dict]:
        """Call sites of the trees as they are now."""
        with self.lock:
            calls = extract_calls(self._named(repo))
            return _rows(navigation.find_usages(calls, symbol, limit).withColumn("repo", F.nullif("repo", F.lit(""))))

    def _named(self, repo: str | None) -> DataFrame:
        """Files of all roots, or of those of one name."""
        roots = [r for r in self.roots if not repo or r.name == repo]
        files = read_workspace(self.spark, roots) if roots else read_workspace(self.spark, self.roots).where("false")
        return files.withColumn("repo", F.lit(roots[0].name)) if len(roots) == 1 < len(self.roots) else files

    def go_to_definition(self, symbol: str, limit: int = DEFINITION_LIMIT, repo: str | None = None) -> list[dict]:
        """Definitions from the index, or from the trees if nothing is indexed."""
        with self.lock:
            chunks = self.indexer.chunks()
            if not chunks.isEmpty():
                hits = navigation.find_definitions(chunks.drop("embedding"), symbol, limit, repo)
                hits = snippets(hits, self.files()).orderBy(F.col("repo").asc_nulls_first(), "file", "start_line", "id")
            else:
                hits = navigation.find_definitions(extract_blocks(self._named(repo)), symbol, limit).withColumnRenamed("block_type", "type")
            named = hits.select("file", "language", "type", "name", F.col("class_chain").alias("class"), "start_line", "end_line", "code", "docstring", F.nullif("repo", F.lit("")).alias("repo"))
            return _rows(named)

    def call(self, tool: str, **arguments) -> str:
        """A tool's answer as indented JSON."""
        key = {"semantic_search": "results", "find_usages": "usages", "go_to_definition": "definitions"}.get(tool)
        if tool != "index_workspace" and key is None:
            return json.dumps({"status": "error", "message": f"no such tool: {tool}"}, indent=2)
        found = getattr(self, tool)(**arguments)
        return json.dumps(found if key is None else {key: found, "count": len(found)}, indent=2, ensure_ascii=False)
