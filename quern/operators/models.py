"""Pluggable models: text to vectors, and pairs of texts to scores. The defaults need no model files."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokenize
from quern.functions.vectors import quantize_binary, quantize_int8, quantize_ubinary, range_arrays
from quern.operators.bm25 import ranked
from quern.schema import DIMENSIONS, SEARCH_LIMIT

BATCH = 64
#: Tokens whose buckets a worker keeps at most.
KEPT = 1 << 18
PRECISIONS = ("float32", "int8", "binary", "ubinary")


class Encoder(Protocol):
    """Turns a batch of texts into rows of one width; must be picklable, and may load its model on first use."""

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class Scorer(Protocol):
    """Turns pairs of query and document into scores."""

    def __call__(self, queries: Sequence[str], documents: Sequence[str]) -> Sequence[float]: ...


class _Buckets(dict):
    """token -> its hash bucket; a token is hashed when it is first met."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        at = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions
        return at


@lru_cache
def _buckets(dimensions: int) -> _Buckets:
    return _Buckets(dimensions)


@dataclass(frozen=True)
class HashedTokens:
    """Feature hashing: token counts by hash bucket, as unit vectors. Lexical, not semantic."""

    dimensions: int = DIMENSIONS

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out, bucket = np.zeros((len(texts), self.dimensions), np.float32), _buckets(self.dimensions).__getitem__
        for i, text in enumerate(texts):
            tokens = tokenize(text or "")
            out[i] = np.bincount(np.fromiter(map(bucket, tokens), np.intp, len(tokens)), minlength=self.dimensions)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


@dataclass(frozen=True)
class TokenOverlap:
    """The share of the query's distinct tokens that a document has."""

    def __call__(self, queries: Sequence[str], documents: Sequence[str]) -> list[float]:
        out = []
        for q, d in zip(queries, documents, strict=True):
            want = set(tokenize(q or ""))
            out.append(len(want & set(tokenize(d or ""))) / len(want) if want else 0.0)
        return out


def encode(rows: DataFrame, encoder: Encoder | None = None, text_col: str = "document", out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Adds unit vectors of a text column, in batches; the encoder stays in the worker from batch to batch."""
    model = encoder or HashedTokens()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            texts = x.fillna("").tolist()
            made = [v for at in range(0, len(texts), batch) for v in np.asarray(model(texts[at : at + batch]), np.float32)]
            yield pd.Series(made, index=x.index)

    return rows.withColumn(out, vectors(F.col(text_col)))


def encode_query(text: str, encoder: Encoder | None = None) -> list[float]:
    return np.asarray((encoder or HashedTokens())([text]), float)[0].tolist()


def quantize(rows: DataFrame, precision: str = "float32", column: str = "embedding", known: DataFrame | None = None) -> tuple[DataFrame, list | None]:
    """Replaces vectors by their codes; for int8 also gives the ranges of the dimensions, which its queries need.

    known: those ranges, where they are stored already.
    """
    if precision not in PRECISIONS:
        raise ValueError(f"precision is one of {PRECISIONS}")
    if precision == "float32":
        return rows, None
    if precision == "int8":
        got = range_arrays(rows, column) if known is None else known
        return rows.crossJoin(F.broadcast(got)).withColumn(column, quantize_int8(F.col(column), F.col("ranges"))).drop("ranges"), got.first()["ranges"]
    pack = quantize_ubinary if precision == "ubinary" else quantize_binary
    return rows.withColumn(column, pack(F.col(column))), None


def rerank(hits: DataFrame, query: str, scorer: Scorer | None = None, document: str = "document", id_col: str = "id", limit: int = SEARCH_LIMIT) -> DataFrame:
    """Scores (query, document) pairs and ranks by that; a blank query leaves the first `limit` hits as they are."""
    if not query.strip():
        return hits.where(F.col("rank") <= limit)
    model = scorer or TokenOverlap()

    @F.pandas_udf("double")
    def score(documents: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model([query] * len(documents), documents.fillna("").tolist()), float))

    return ranked(hits.drop("rank").withColumn("score", score(F.col(document))), id_col, limit)


def model_name(given: str | None, variable: str, other: str) -> str:
    """The name of a model: the one given, or else an environment variable's, or else the default."""
    return given or os.environ.get(variable) or other


