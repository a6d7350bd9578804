import math

import numpy as np
import pytest
from helpers import DATA, same_rows
from pyspark.sql import functions as F

from quern.llm import topk_search as S


def brute(rows, k, queries):
    vs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in vs:
        if queries(q):
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vs if i != q and len(b) == len(a))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(found, 1)}
    return out


def run(spark, rows, k=10, queries=lambda i: i % 5 == 0):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    return {tuple(r) for r in S.top_k(df, lambda c: F.pmod(c, F.lit(5)) == 0, k=k).collect()}, brute(rows, k, queries)


def test_sql(spark):
    same_rows(S.op3_topk_search(spark, str(DATA)), S.OP3_SQL)


def test_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(S, "BUCKET", 16)
    monkeypatch.setattr(S, "BLOCK", 8)
    wide = [(int(i), (rng.normal(size=20) * 10 ** rng.uniform(-2, 2)).tolist()) for i in range(200)]
    got, want = run(spark, wide)
    assert got == want
    same = [(int(i), [0.5, 0.5] if i % 3 else [1.0, -1.0]) for i in range(60)]
    got, want = run(spark, same)
    assert got == want
    close = [(int(i), (np.ones(24) + rng.normal(size=24) * 0.05).tolist()) for i in range(90)]  # cosines near 1: coordinates prune
    got, want = run(spark, close, 3)
    assert got == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (6, [3.0]), (7, [-1.0, 0.25]), (None, [1.0, 1.0]), (8, []), (10, [1e6, -1e6]), (15, [7.0])]
    got, want = run(spark, rows)
    assert got == want and got
    assert run(spark, rows[:0]) == (set(), set())


def test_pruning_keeps_all():
    rng = np.random.default_rng(8)
    v = rng.integers(-1000, 1000, (500, 32))
    v[::7] //= 9
    vid, q, qid = np.arange(500), v[:6], np.arange(6)
    full = S.search_bucket(q, qid, np.full(6, np.nan), v, vid, 10)
    floor = full.groupby("query_id").score.min().to_numpy().astype(float)
    again = S.search_bucket(q, qid, floor, v, vid, 10)
    key = ["query_id", "score", "vec_id"]
    assert full.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_buckets_out_of_reach_move_no_vectors(spark, monkeypatch):
    """With lengths far apart, all but a few of more than a hundred buckets are skipped before their vectors are fetched."""
    monkeypatch.setattr(S, "BUCKET", 16)
    monkeypatch.setattr(S, "BLOCK", 16)
    seen = []
    plain = S._met
    monkeypatch.setattr(S, "_met", lambda pairs, *more: seen.append(pairs.count()) or plain(pairs, *more))
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=8) * 1.02**-i).tolist()) for i in range(1800)]
    got, want = run(spark, rows, 3, lambda i: i % 5 == 0)
    blocks = seen[0]  # of queries: each meets one bucket at first
    assert got == want and blocks >= 20 and seen[1] < 0.25 * 100 * blocks


def test_long_products(spark):
    """Products beyond 2**52 are exact; what is no long is an error, never wrapped or left out."""
    rows = [(0, [2.0**20, 1.0]), (5, [2.0**20, -3.0]), (1, [2.0**20 + 1, 7.0]), (2, [-(2.0**21), 0.0]), (3, [2.0**-10, 0.0])]
    got, want = run(spark, rows)
    assert got == want and max(r[3] for r in got) > 2**60
    for bad in ([2.0**40, 0.0], [2.0**60, 0.0], [1e300, 0.0]):
        with pytest.raises(Exception, match="beyond a long"):
            run_only(spark, [(0, bad), (5, bad)])


def run_only(spark, rows):
    return S.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: F.pmod(c, F.lit(5)) == 0).collect()


def test_products_that_take_no_part_may_be_beyond_a_long(spark):
    rows = [(0, [2.0**40]), (50, [1.5]), (100, [2.0])]
    got = S.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: F.pmod(i, F.lit(100)) == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(0, 1, 100, 2**61), (0, 2, 50, 1536 << 50), (100, 1, 0, 2**61), (100, 2, 50, 2048 * 1536)}
