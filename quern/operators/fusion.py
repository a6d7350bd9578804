"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.bm25 import ranked
from quern.schema import RRF_K, SEARCH_LIMIT, USAGE_CAP, W_GRAPH, W_KEYWORD, W_VECTOR


def contribution(rank: Column, weight: float, k: int = RRF_K) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(F.lit(weight) / (k + rank))


def fuse(vector: DataFrame, keyword: DataFrame, graph: DataFrame | None = None, k: int = RRF_K, w_vector: float = W_VECTOR, w_keyword: float = W_KEYWORD, w_graph: float = W_GRAPH, limit: int | None = SEARCH_LIMIT, id_col: str = "id") -> DataFrame:
    """id, score, rank from lists of (id, rank). Ids that only the graph ranks are left out; a weight of 0 or less leaves the graph out."""
    v, w = (x.select(F.col(id_col), F.col("rank").alias(n)) for x, n in ((vector, "__v"), (keyword, "__k")))
    both = v.join(w, id_col, "full_outer")
    score = contribution(F.col("__v"), w_vector, k) + contribution(F.col("__k"), w_keyword, k)
    if graph is not None and w_graph > 0:
        both = both.join(graph.select(F.col(id_col), F.col("rank").alias("__g")), id_col, "left")
        score += contribution(F.col("__g"), w_graph, k)
    return ranked(both.select(id_col, score.alias("score")), id_col, limit)


def pool(vector: DataFrame, keyword: DataFrame, id_col: str = "id") -> DataFrame:
    """Candidates of both lists, each once: id and pos, vector hits first, then new keyword hits, by rank."""
    each = vector.select(id_col, F.struct(F.lit(0).alias("list"), "rank").alias("pos")).unionByName(keyword.select(id_col, F.struct(F.lit(1).alias("list"), "rank").alias("pos")))
    return each.groupBy(id_col).agg(F.min("pos").alias("pos"))


def graph_ranks(candidates: DataFrame, counts: DataFrame, name_col: str = "name", cap: int = USAGE_CAP, id_col: str = "id") -> DataFrame:
    """Ranks candidates (id, name, pos) by capped call counts (name, n) of their trimmed names, then by pos; no calls count as 0."""
    named = candidates.withColumn("__name", F.trim(name_col))
    n = F.least(F.coalesce("n", F.lit(0)), F.lit(cap))
    found = named.join(counts.select(F.col(name_col).alias("__name"), "n"), "__name", "left").withColumn("calls", n)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("calls"), "pos", id_col))).select(id_col, "calls", "rank")


def widened(limit: int, rerank: bool) -> tuple[int, int]:
    """How many candidates a re-ranked search needs, and how many each of the two lists gives."""
    candidates = max(limit * 3, 15) if rerank else limit
    return candidates, max(candidates * 2, 10)
