"""What an index run moves and what it keeps on disk."""

import re
import time
from pathlib import Path

from helpers import DATA
from pyspark.sql import functions as F

from quern import code_queries as C
from quern.operators import bm25
from quern.operators.chunking import chunk_blocks
from quern.operators.models import HashedTokens
from quern.plans import scratch
from quern.plans.indexing import Indexer
from quern.schema import BLOCKS
from quern.sources.versions import Versions


def documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("source", "lang", F.concat(F.lit("docs/"), "doc_id").alias("file"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return docs.select(F.col("source").alias("repo"), "file", F.length("content").cast("long").alias("size"), F.lit(1.0).alias("mtime"), F.col("lang").alias("language"), "content")


def test_texts_and_postings_move_once_and_are_stored_small(spark, tmp_path, monkeypatch):
    moved, write = {}, Versions.write

    def counted(self, name, df, base):
        moved[name] = len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))
        return write(self, name, df, base)

    monkeypatch.setattr(Versions, "write", counted)
    own = Indexer(spark, str(tmp_path / "i"), C.EXAMPLES, encoder=HashedTokens(16), blocks=C.document_blocks, calls=C.no_calls)
    files = documents(spark)
    assert own.index(files).added == files.count()
    assert moved["chunks"] == moved["postings"] == 1 and moved["lengths"] == 0
    size = sum(p.stat().st_size for p in Path(tmp_path / "i").rglob("*.parquet"))
    assert size < 1.3 * files.selectExpr("sum(size)").first()[0]  # footers of small files included; it was 1.62 times
    # and nothing is missing
    whole = bm25.build(own.chunks())
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(own.keyword_index().postings, "id", "term", "tf") == rows(whole.postings, "id", "term", "tf")
    assert rows(own.keyword_index().lengths, "id", "dl") == rows(whole.lengths, "id", "dl")
    own.index(files.where("repo <> 'src3'"))
    whole, left = bm25.build(own.chunks()), own.keyword_index()
    assert rows(left.postings, "id", "term", "tf") == rows(whole.postings, "id", "term", "tf")
    assert rows(left.frequencies.where("df <> 0"), "term", "df") == rows(whole.frequencies, "term", "df")
    own.compact()
    assert rows(own.keyword_index().postings, "id", "term", "tf") == rows(whole.postings, "id", "term", "tf")


def test_exchanges_of_a_write_are_dropped(spark, tmp_path):
    dirs = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {p for d in dirs for p in d.rglob("shuffle_*")}
    before, was = held(), spark.conf.get(scratch._DROPS, None)
    store = Versions(spark, f"file://{tmp_path}/v")
    at = store.write("t", spark.range(200_000).repartition(4, "id"), store.version())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(scratch._DROPS, None) == was
    assert store.read([at], "id long").count() == 200_000


def test_chunks_in_order_are_the_same_chunks(spark):
    """Repeated ids, names that look like parts, and names with the separator, are numbered alike in order or not."""
    text = "\n".join(f"line {i} " + "x" * 60 for i in range(90))
    names = [("f", "", "x@part1", "a"), ("f", "", "x", text), ("f", "", "x", "b"), ("f", "A", "B::c", "d"), ("f", "A::B", "c", "e"), ("f", "", "x0", "g"), ("h", "", "x", text), ("h", "", "", "i")]
    rows = [("r", f, "python", "function", n, c, 1, 1, code, "", i) for i, (f, c, n, code) in enumerate(names)]
    blocks = spark.createDataFrame(rows, BLOCKS)
    want, ordered = chunk_blocks(blocks), chunk_blocks(blocks, in_order=True)
    assert len(re.findall(r"\bExchange ", ordered._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, ordered.collect()))
    ids = [r["id"] for r in ordered.collect()]
    assert len(set(ids)) == len(ids) and "r::f::x@part1#2" in ids
