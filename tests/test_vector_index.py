import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.vector_index import VectorIndex
from quern.operators.vector_search import vector_top_k

TABLE = "/root/testdata/sf0.1/embeddings.parquet"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = spark.read.parquet(TABLE)
    return VectorIndex.build(rows, str(tmp_path_factory.mktemp("index") / "i"), "vec_id", "embedding", "label")


def found(df):
    return [(r["id"], r["score"], r["rank"]) for r in df.collect()]


def scan(spark, vector, limit, where=None):
    rows = spark.read.parquet(TABLE).select(F.col("vec_id").alias("id"), "label", "embedding")
    return found(vector_top_k(rows, vector, limit=limit, where=where, digits=6))


def vectors(spark, n, seed=0):
    rows = spark.read.parquet(TABLE).orderBy("vec_id").limit(400).select("embedding").collect()
    rng = np.random.default_rng(seed)
    own = [r["embedding"] for r in rows[:: 400 // n]][:n]
    return [(np.array(v) + rng.normal(0, 0.05, len(v))).tolist() for v in own]


def bytes_read(spark, run):
    """Bytes that Hadoop's file systems gave out during a call."""
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics
    total = lambda: sum(s.getBytesRead() for s in stats())
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")  # vectored reads of local files are not counted
    spark.conf.set("io.file.buffer.size", "4096")  # each seek fills a buffer, which is large beside this table
    try:
        before = total()
        run()
        return total() - before
    finally:
        spark.conf.unset("parquet.hadoop.vectored.io.enabled")
        spark.conf.unset("io.file.buffer.size")


def test_every_row_is_in_it(spark, index):
    n = spark.read.parquet(TABLE).count()
    assert index.rows == n == index.codes.select("id").distinct().count() == index.vectors.count()
    assert index.groups.agg(F.sum("n")).first()[0] == n and index.recall >= 0.97


def test_recall(spark, index):
    asked = vectors(spark, 12)
    hit = sum(len({i for i, *_ in found(index.search(v, 10))} & {i for i, *_ in scan(spark, v, 10)}) for v in asked)
    assert hit / (10 * len(asked)) >= 0.9


def test_exact_and_filtered(spark, index):
    for v in vectors(spark, 3, 1):
        assert found(index.search(v, 10, exact=True, digits=6)) == scan(spark, v, 10)
        assert found(index.search(v, 10, group="3", exact=True, digits=6)) == scan(spark, v, 10, F.col("label") == 3)
        near = {i for i, *_ in found(index.search(v, 10, group="3"))}
        assert len(near) == 10 and len(near & {i for i, *_ in scan(spark, v, 10, F.col("label") == 3)}) >= 8
    assert found(index.search(v, 10, group="none")) == []


def test_bytes(spark, tmp_path):
    """A query reads less than a third of what a scan of the vectors reads, once the table is larger than a few file buffers: here eight rotations of each vector."""
    turned = spark.read.parquet(TABLE).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("at", F.col("turn") * 8)
    turned = turned.select((F.col("vec_id") * 8 + F.col("turn")).alias("id"), F.concat(F.slice("embedding", F.col("at") + 1, 64), F.slice("embedding", 1, F.col("at"))).alias("embedding"))
    index = VectorIndex.build(turned, str(tmp_path / "i"))
    (v,) = vectors(spark, 1)
    rows = spark.read.parquet(index.path + "/vectors").select("id", "embedding")
    whole = bytes_read(spark, lambda: vector_top_k(rows, v, limit=10).collect())
    own = bytes_read(spark, lambda: index.search(v, 10).collect())
    assert 0 < own < whole / 3, (own, whole)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "a" if i % 2 else None, rng.normal(size=8).tolist()) for i in range(50)]
    rows += [(100, "a", None), (101, "a", [0.0] * 8), (102, "b", [1.0, 2.0]), (103, "a", [float("nan")] + [1.0] * 7), (104, "a", []), (104, "a", [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, repo string, embedding array<double>, cell int")
    index = VectorIndex.build(df, str(tmp_path / "odd"), group_col="repo")
    q = rng.normal(size=8).tolist()
    assert index.rows == len(rows)
    # as a scan has it: not a number first, no score (another width, null) last
    assert str(found(index.search(q, 60, exact=True, digits=6))) == str(found(vector_top_k(df.select("id", "embedding"), q, limit=60, digits=6)))
    assert {r[0] for r in found(index.search(q, 5, probes=100))} == {r[0] for r in found(vector_top_k(df.where("id < 50").select("id", "embedding"), q, limit=5))}
    assert found(index.search(q[:2], 1)) == found(vector_top_k(df.where(F.size("embedding") == 2).select("id", "embedding"), q[:2], limit=1))
    none = VectorIndex.build(df.where("false"), str(tmp_path / "none"))
    assert none.search([], 3).collect() == [] and none.search([1.0], 3, exact=True).collect() == []
    few = VectorIndex.build(df.where("id = 100"), str(tmp_path / "few"), group_col="repo")
    assert [r["id"] for r in few.search([1.0], 3).collect()] == [100]
