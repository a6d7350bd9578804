"""Exact vector top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import cosine, hamming
from quern.operators.bm25 import ranked
from quern.schema import SEARCH_LIMIT


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_top_k(rows: DataFrame, vector: Sequence[float], column: str = "embedding", id_col: str = "id", limit: int = SEARCH_LIMIT, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """The rows most like a vector by cosine, 1 - distance, as score and rank. `where` is applied before the search.

    The query is a constant of the plan: one scan of the vectors' column, a partial top-k in each task, and no
    shuffle but that of the few best. digits rounds scores before they are compared.
    """
    rows = rows.where(where) if where is not None else rows
    score = cosine(F.col(column), literal(vector))
    scored = rows.withColumn("score", score if digits is None else F.round(score, digits)).drop(column)
    return ranked(scored, id_col, limit)


def hamming_top_k(rows: DataFrame, code: Sequence[int], column: str, id_col: str = "id", limit: int = SEARCH_LIMIT) -> DataFrame:
    """The rows whose packed bits differ least from a code: distance and rank."""
    scored = rows.withColumn("distance", hamming(F.col(column), F.array(*map(F.lit, code)))).drop(column)
    return ranked(scored.withColumn("score", -F.col("distance")), id_col, limit).drop("score")
