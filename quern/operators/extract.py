"""Definitions and call sites of source files, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quern.operators import scanner
from quern.schema import BLOCKS, CALLS, EXTENSIONS, FILE_BYTES, SNIFF_BYTES


def readable(files: DataFrame) -> DataFrame:
    """Files of a known language within the size limit and without a NUL in their first bytes."""
    head = F.substring(F.col("content"), 1, SNIFF_BYTES)
    return files.where((F.col("size") <= FILE_BYTES) & F.col("language").isNotNull() & ~F.contains(head, F.lit(b"\x00")))


def _blocks(batches):
    for x in batches:
        rows = []
        for r in x.itertuples(index=False):
            source = bytes(r.content).decode("utf-8", "replace")
            for i, (kind, name, chain, first, last, doc, code) in enumerate(scanner.blocks(source, r.language)):
                rows.append((r.repo, r.file, r.language, kind, name, chain, first, last, code, doc, i))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def _calls(batches):
    for x in batches:
        rows = []
        for r in x.itertuples(index=False):
            source = bytes(r.content).decode("utf-8", "replace")
            for i, (callee, line, preview) in enumerate(scanner.calls(source, r.language)):
                rows.append((r.repo, r.file, r.language, callee, callee.strip().replace("::", ".").replace("->", "."), line, preview, i))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALLS.split(", ")])


@udtf(returnType="block_type string, name string, class_chain string, start_line int, end_line int, docstring string, code string, block_pos int")
class BlocksOf:
    """extract_blocks(language, source) in SQL: the definitions of one source text."""

    def eval(self, language: str, source: str):
        if source is not None and language in EXTENSIONS:
            for i, b in enumerate(scanner.blocks(source, language)):
                yield (*b, i)


@udtf(returnType="callee string, line int, preview string, pos int")
class CallsOf:
    """extract_calls(language, source) in SQL: the call sites of one source text."""

    def eval(self, language: str, source: str):
        if source is not None and language in EXTENSIONS:
            for i, c in enumerate(scanner.calls(source, language)):
                yield (*c, i)


def register(spark: SparkSession) -> None:
    """Makes both table functions callable from spark.sql, laterally too."""
    spark.udtf.register("extract_blocks", BlocksOf)
    spark.udtf.register("extract_calls", CallsOf)


_INPUT = ("repo", "file", "language", "content")


def extract_blocks(files: DataFrame) -> DataFrame:
    """A row per definition, in the order of the file."""
    return readable(files).select(*_INPUT).mapInPandas(_blocks, BLOCKS)


def extract_calls(files: DataFrame) -> DataFrame:
    """A row per call site, outer calls before inner ones."""
    return readable(files).select(*_INPUT).mapInPandas(_calls, CALLS)
