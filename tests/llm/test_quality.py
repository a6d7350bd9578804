import zlib

import numpy as np
from helpers import DATA
from pyspark.sql import functions as F

from quern.llm import quality as Q


def test_held_out_accuracy(spark):
    data = DATA.parent / "sf0.01"
    got = {r["doc_id"]: r for r in Q.op4_quality(spark, str(data)).collect()}
    labels = [r for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] for r in labels)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.", None, "", "| a | b |\nLOUD!! LOUD!!", "x " * 1000]
    whole = Q.features(texts)
    assert np.allclose(whole, np.concatenate([Q.features([t]) for t in texts])) and not whole[1][:12].any()


def test_ranking_learns_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x @ [2.0, -1, 0, 0, 0] > 0.5).astype(int)
    r = Q.Ranker(x, y)
    r.calibrate(x, y, float((y == 0).mean()))
    assert ((r.probability(x) >= 0.5) == y).mean() > 0.97


def test_odd_documents(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (4, 1, None), (7, 0, 1), (None, 1, 1), (9, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.score_quality(odd, labels, F.lit(False)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in Q.score_quality(odd, labels.where("quality = 1"), F.lit(False)).collect()} == {1.0}
    assert {r["score"] for r in Q.score_quality(odd, labels, F.lit(True)).collect()} == {0.5}
    assert Q.score_quality(nothing, labels, F.lit(False)).count() == 0


def test_every_label_counts(spark, monkeypatch):
    """Labels beyond any number take part, in shards of which each has both labels; the cut is that of all of them."""
    monkeypatch.setattr(Q, "SHARD", 100)
    monkeypatch.setattr(Q, "HELD", 50)
    n = 10_000
    # the first of them by hash would be fitted to word length alone; that odd marks tell more is in all of them
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, "| # | #").otherwise("plain words here").alias("text"), (F.col("id") % 500 != 0).cast("int").alias("quality"))
    got = {r["doc_id"]: r["score"] for r in Q.score_quality(docs, docs.select("doc_id", "quality"), F.lit(False)).collect()}
    assert len(got) == n and min(s for i, s in got.items() if i % 500) > 0.5 > max(s for i, s in got.items() if not i % 500)
    seen = []
    monkeypatch.setattr(Q, "_total", lambda shards, measure, total=Q._total: seen.append(total(shards, measure)) or seen[-1])
    Q.score_quality(docs, docs.select("doc_id", "quality"), F.lit(False))
    assert seen[0][0] >= n and all(s[0] >= 2 * Q.RIVALS * n * 0.99 / 2 for s in seen[1:])


def test_nth(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 5)
    monkeypatch.setattr(Q, "BINS", 8)
    x = np.round(np.random.default_rng(1).normal(size=300) ** 3, 1)
    rows = spark.createDataFrame([(float(v),) for v in x], "s double")
    assert [Q.nth(rows, "s", k) for k in (0, 7, 150, 299)] == [sorted(x.tolist())[k] for k in (0, 7, 150, 299)]
