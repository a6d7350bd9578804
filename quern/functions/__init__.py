"""Column functions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL bodies, so that calls are inlined into the plan and stay in the JVM.
_SQL = {
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": """
        CASE WHEN size(a) = size(b) THEN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
            sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D) END""",
    "rrf_score(rank INT, weight DOUBLE, k INT) RETURNS DOUBLE": "CASE WHEN rank IS NULL THEN 0D ELSE weight / (k + rank) END",
    "normalize_symbol(symbol STRING) RETURNS STRING": "replace(replace(trim(symbol), '::', '.'), '->', '.')",
    "tokenize_code(text STRING) RETURNS ARRAY<STRING>": r"""
        flatten(transform(filter(split(coalesce(text, ''), r'\W+'), x -> x <> ''), x -> transform(concat(array(x),
            CASE WHEN contains(x, '_') THEN filter(split(x, '_'), y -> y <> '') ELSE CAST(array() AS ARRAY<STRING>) END,
            CASE WHEN x RLIKE '[a-z0-9][A-Z]' THEN split(regexp_replace(x, '([a-z0-9])([A-Z])', '$1 $2'), ' ') ELSE CAST(array() AS ARRAY<STRING>) END),
            y -> lower(y))))""",
}


def register(spark: SparkSession) -> None:
    """Makes cosine_similarity, rrf_score, normalize_symbol and tokenize_code callable from spark.sql."""
    for signature, body in _SQL.items():
        head, _, returns = signature.partition(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
