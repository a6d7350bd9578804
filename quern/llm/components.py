"""Connected components by alternating star contractions, with no group gathered anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop, store


def _least(edges: DataFrame) -> DataFrame:
    """Each u's least v, as a table of its own: joins with it then have an exchange on either side, which adaptive
    execution can split where one u (the centre of a star) has a large share of the edges."""
    return store(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) long edges -> (node, label): label is the least node of the component; nodes without an edge are left out.

    Each round hangs every larger neighbour of a node on the least node around it (large star), then does
    the same for smaller neighbours (small star); edges never grow in number, and it ends as a round changes
    nothing. Every node's least neighbour comes from a pre-aggregated groupBy and an equi-join.
    """
    now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        large = store(large, "edges")
        drop(least)
        least = _least(large)
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, now = now, store(small, "edges")
        drop(old, large, least)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("star contraction did not end")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least index) of 0..n-1 under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label
