"""Exact inner-product top-k by norm buckets.

Vectors stand in buckets of about equal length. Each query first meets one bucket whole, which gives a floor
for its k-th score; for each other bucket the floor becomes a local cosine threshold, floor / (|query| *
longest in the bucket). Above 1 the bucket is skipped; at a low threshold lengths prune (only vectors of at
least floor / |query| can count); at a high one coordinates prune (products over the query's strongest
coordinates, bounded by Cauchy and Schwarz over the rest). Survivors are verified by whole products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import drop, small_batches, store, table

BUCKET, BLOCK, K, SCALE = 8192, 1024, 10, 1024
#: Blocks of queries that meet one copy of a bucket.
TOGETHER = 64
#: Cosine thresholds from which coordinates prune, and the number of coordinates.
COORDINATES_FROM, COORDINATES = 0.6, 16
_KIND = "dims int, block long, ids binary, data binary, width int, longest double"


def _pack(rows: list[list[int]], dims: int) -> tuple[np.ndarray, bytes, int]:
    """Whole numbers as an array, and as bytes of the least width that holds them."""
    data = np.array(rows, np.int64).reshape(len(rows), dims)
    most = max(int(data.max()), -int(data.min())) if data.size else 0
    width = next(w for w in (2, 4, 8) if w == 8 or most < 1 << (8 * w - 1))
    return data, data.astype(f"<i{width}").tobytes(), width


def _unpack(raw: bytes, width: int, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(n, dims).astype(np.int64)


def _blocks(batches, size: int):
    """Sorted rows -> blocks of at most `size` vectors of one dimension."""
    held: dict[int, list] = {}
    made = 0

    def out(dims: int):
        nonlocal made
        rows = held.pop(dims)
        ids = np.array([r[0] for r in rows], np.int64)
        data, raw, width = _pack([r[1] for r in rows], dims)
        longest = math.sqrt(max(float((data.astype(float) ** 2).sum(1).max()), 0.0)) if dims else 0.0
        made += 1
        return pd.DataFrame({"dims": [dims], "block": [made], "ids": [ids.tobytes()], "data": [raw], "width": [width], "longest": [longest]})

    for x in batches:
        for i, v in zip(x["id"], x["v"], strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((i, v))
            if len(rows) >= size:
                yield out(len(v))
    for dims in list(held):
        yield out(dims)


def _norms(data: np.ndarray) -> np.ndarray:
    return np.sqrt((data.astype(float) ** 2).sum(1))


def _products(a: np.ndarray, b: np.ndarray, la: float, lb: float) -> np.ndarray:
    """Exact integer products a @ b.T: no partial sum exceeds the product of the lengths. Those beyond a long become its ends."""
    if la * lb < 2.0**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if la * lb < 2.0**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if la * lb < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= floor)
        return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_bucket(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int):
    """Rows (query, vector, score): each query's k best in the bucket among those that reach its floor (nan: none)."""
    length, own = _norms(v), _norms(q)
    longest = float(length.max()) if len(length) else 0.0
    order = np.argsort(-length, kind="stable")
    v, vid, length = v[order], vid[order], length[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(np.isnan(floor), -np.inf, floor / (own * longest))
    cosine[np.isnan(cosine)] = -np.inf  # a zero query or bucket: all scores are 0
    out = []
    eps = 1e-9
    by_length = np.flatnonzero(cosine < COORDINATES_FROM)
    for at in range(0, len(by_length), 256):
        rows = by_length[at : at + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where((floor[rows] > 0) & (own[rows] > 0), floor[rows] / own[rows], 0.0)
        n = len(v) if not len(least) else int(np.searchsorted(-length, -least.min() * (1 - eps), side="right"))
        score = _products(q[rows], v[:n], float(own[rows].max()), longest)
        for r, s in zip(rows, score, strict=True):
            out.append(_take(qid[r], s, vid[:n], floor[r], k))
    for r in np.flatnonzero((cosine >= COORDINATES_FROM) & (cosine <= 1 + eps)):
        focus = np.argsort(-np.abs(q[r]), kind="stable")[:COORDINATES]
        part = v[:, focus].astype(float) @ q[r, focus].astype(float)
        rest = np.sqrt(np.maximum(length**2 - (v[:, focus].astype(float) ** 2).sum(1), 0)) * math.sqrt(max(own[r] ** 2 - float((q[r, focus].astype(float) ** 2).sum()), 0))
        some = np.flatnonzero(part + rest >= floor[r] - eps * own[r] * longest - 1e-6)
        if len(some):
            out.append(_take(qid[r], _products(q[r][None], v[some], float(own[r]), longest)[0], vid[some], floor[r], k))
    none = np.zeros(0, np.int64)
    parts = [np.concatenate(p) for p in zip(*out, strict=True)] if out else [none, none, none]
    return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})


def _take(query: int, score: np.ndarray, ids: np.ndarray, floor: float, k: int):
    ok = ids != query
    if not np.isnan(floor):
        ok &= score >= floor
    i = np.flatnonzero(ok)
    i = i[_best(score[i], ids[i], k)]
    return np.full(len(i), query), ids[i], score[i]


def _search(k: int):
    """Runs of rows of one (block, part): the bucket first, then blocks of queries that it meets."""

    def run(batches):
        now = v = vid = None
        for x in batches:
            for r in x.itertuples():
                n = len(r.ids) // 8
                ids, data = np.frombuffer(r.ids, np.int64), _unpack(r.data, r.width, r.dims, n)
                if r.role == 0:
                    now, v, vid = (r.block, r.part), data, ids
                elif (r.block, r.part) == now:
                    floor = np.frombuffer(r.floors, np.float64) if r.floors is not None else np.full(n, np.nan)
                    yield search_bucket(data, ids, floor, v, vid, k)

    return run


def _floors(batches):
    """Blocks of queries -> floors of their queries, and the least length of a vector that any of them can still take."""
    for x in batches:
        floors, least = [], []
        for r in x.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            known = {} if r.known is None else {i["query_id"]: float(i["floor"]) for i in r.known}
            f = np.array([known.get(i, np.nan) for i in ids.tolist()], float)
            f = np.where(np.abs(f) >= 2.0**53, np.nextafter(f, -np.inf), f)  # a long rounded up would be too high
            own = _norms(_unpack(r.data, r.width, r.dims, len(ids)))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(np.isnan(f) | (f <= 0) | (own == 0), 0.0, f / own)
            floors.append(f.tobytes())
            least.append(float(need.min()) * (1 - 1e-9))
        yield x.drop(columns="known").assign(floors=floors, least=least)


def _met(pairs: DataFrame, buckets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each bucket that its block meets; pairs: block, q_block.

    Vectors move for these pairs only: a block of queries once for each of its buckets, a bucket once for every
    TOGETHER blocks that it meets.
    """
    pairs = pairs.join(pairs.groupBy("block").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")), "block")
    pairs = store(pairs.select("block", "q_block", F.pmod(F.xxhash64("q_block"), F.col("parts")).alias("part")), "pairs")
    shape = ["block", "part", "role", "dims", "ids", "data", "width", "floors"]
    own = pairs.select("block", "part").distinct()
    n = own.count()
    asked = pairs.join(queries.withColumnRenamed("block", "q_block"), "q_block").withColumn("role", F.lit(1)).select(*shape)
    rows = buckets.join(own, "block").withColumns({"role": F.lit(0), "floors": F.lit(None).cast("binary")}).select(*shape).unionByName(asked)
    rows = rows.repartition(max(1, min(n, 10_000)), "block", "part").sortWithinPartitions("block", "part", "role")
    return rows.mapInPandas(_search(k), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over all other ids.

    Components x become floor(scale * x). Vectors that are null or hold a null or non-finite component take no
    part, nor do null ids; products are between vectors of one dimension; ids given more than once are vectors of
    their own, of which none is a candidate of its own id. Ties go to the smaller vec_id, then to any. Fewer than
    k candidates are all returned; an empty table gives an empty table; other columns are not read. A component of
    2**62 or more after scaling, or a product among those returned that is no less than a long's ends, is an error.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e")).where("id is not null and e is not null")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x * float(scale)) < 2.0**62, F.floor(x * float(scale))).otherwise(F.raise_error(F.lit("a component of a vector is beyond a long")).cast("long"))
    v = store(v.where(fine).select("id", F.transform("e", whole).alias("v")), "vectors")
    n, longest = v.count(), F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    parts = max(1, math.ceil(n / (2 * BUCKET)))
    # ties of length go by the id, so that very common vectors still fill many buckets
    ranged = v.withColumn("l", longest).repartitionByRange(parts, F.desc("l"), "id").sortWithinPartitions(F.desc("l"), "id").select("id", "v")
    buckets = store(ranged.mapInPandas(lambda b: _blocks(b, BUCKET), _KIND).withColumn("block", F.monotonically_increasing_id()), "buckets")
    asked = v.where(is_query(F.col("id")))
    n_asked = asked.count()
    asked = asked.repartitionByRange(max(1, math.ceil(n_asked / BLOCK)), "id").mapInPandas(lambda b: _blocks(b, BLOCK), _KIND)
    asked = store(asked.withColumn("block", F.monotonically_increasing_id()), "queries")
    # each block of queries meets the longest bucket of its dimension whole: that gives its queries their floors
    first = buckets.groupBy("dims").agg(F.max_by("block", F.struct("longest", F.length("ids"), "block")).alias("block"))
    no_floors = asked.withColumn("floors", F.lit(None).cast("binary"))
    seeds = store(_met(asked.select("dims", F.col("block").alias("q_block")).join(F.broadcast(first), "dims").select("block", "q_block"), buckets, no_floors, k), "seeds")
    floors = seeds.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("c")).where(F.col("c") >= k)
    listed = asked.mapInPandas(_members, "block long, query_id long").join(floors, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))
    ready = asked.join(listed, "block", "left").select("dims", "block", "ids", "data", "width", "known")
    ready = store(ready.mapInPandas(_floors, "dims int, block long, ids binary, data binary, width int, floors binary, least double"), "ready")
    # lengths alone decide which buckets a block still meets; these rows are light, and salted against a common dimension
    salts = max(1, math.isqrt(parts))
    light = buckets.join(first, ["dims", "block"], "left_anti").select("dims", "block", "longest", F.pmod("block", F.lit(salts)).alias("salt"))
    asking = ready.select("dims", F.col("block").alias("q_block"), "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = light.join(asking, ["dims", "salt"]).where(F.col("longest") >= F.col("least")).select("block", "q_block")
    rows = seeds.unionByName(_met(pairs, buckets, ready, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    drop(v)
    beyond = F.col("score").isin(2**63 - 1, -(2**63))
    score = F.when(beyond, F.raise_error(F.lit("an inner product of these vectors is beyond a long")).cast("long")).otherwise(F.col("score"))
    return out.select("query_id", "rank", "vec_id", score.alias("score"))


def _members(batches):
    for x in batches:
        for b, raw in zip(x["block"], x["ids"], strict=True):
            ids = np.frombuffer(raw, np.int64)
            yield pd.DataFrame({"block": np.full(len(ids), b), "query_id": ids})


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: F.pmod(i, F.lit(100)) == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
