"""python -m quern index|search|usages|definitions|watch ROOTS ...: the tools on the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quern.api import Workspace
from quern.operators.models import PRECISIONS
from quern.plans.indexing import IndexStats
from quern.plans.search import MODES
from quern.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("tool", choices=("index", "search", "usages", "definitions", "watch"))
    p.add_argument("roots", help="one directory, or several with commas between")
    p.add_argument("text", nargs="?", default="", help="the query or symbol")
    p.add_argument("--limit", type=int)
    p.add_argument("--mode", default="hybrid", choices=MODES)
    p.add_argument("--rerank", action="store_true")
    p.add_argument("--repo")
    p.add_argument("--index", help="where the index is kept")
    p.add_argument("--precision", default="float32", choices=PRECISIONS)
    return p


def log_line(s: IndexStats) -> str | None:
    """What a watch says about a run; nothing if it changed nothing."""
    return f"indexed {s.chunks} chunks, {s.deleted} files deleted, {s.total} chunks in all" if s.chunks or s.deleted else None


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    w = Workspace(SparkSession.builder.appName("quern").getOrCreate(), a.roots, a.index, precision=a.precision)
    if a.tool == "watch":

        def tell(s) -> None:
            if line := log_line(s):
                print(line, file=sys.stderr, flush=True)

        # beside the index, so that a restart goes on where the last run ended
        watch(w.spark, w.indexer, f"{w.indexer.store.path}/_watch", tell, lock=w.lock).awaitTermination()
        return 0
    more = {"limit": a.limit} if a.limit else {}
    calls = {
        "index": ("index_workspace", {}), "search": ("semantic_search", {"query": a.text, "mode": a.mode, "rerank": a.rerank, "repo": a.repo} | more),
        "usages": ("find_usages", {"symbol": a.text, "repo": a.repo} | more), "definitions": ("go_to_definition", {"symbol": a.text, "repo": a.repo} | more),
    }
    tool, given = calls[a.tool]
    print(w.call(tool, **given))
    return 0


if __name__ == "__main__":
    sys.exit(main())
