"""What a search computes, and how often."""

import re

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from quern import code_queries as C
from quern.functions.text import tokenize
from quern.operators import bm25
from quern.operators.models import HashedTokens
from quern.plans.indexing import Indexer
from quern.plans.search import Searcher


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("mode", "times"), [("hybrid", 1), ("semantic", 1), ("keyword", 0)])
def test_each_chunk_is_encoded_once(spark, mode, times):
    class Counted:
        """The default encoder, which counts the texts that it gets."""

        def __call__(self, given):
            texts.add(len(given))
            return HashedTokens()(given)

    texts = spark.sparkContext.accumulator(0)
    corpus = C._Corpus(spark, str(DATA), encoder=Counted())
    many = corpus.chunks().count()
    texts.value = 0
    assert Searcher(corpus).search("reading thing clown", mode=mode, rerank_hits=mode == "keyword").count() == 5
    assert texts.value == (many + 1) * times  # and the query


def test_searched_rows_are_stored(spark):
    """Neither chunks nor numbers of symbols are made anew for each of their uses, nor a search's ranges pushed into the making."""
    corpus = C._Corpus(spark, str(DATA))
    assert "Aggregate" not in _plan(corpus.symbols()) and "Window" not in _plan(corpus.stored)
    assert "Window" not in _plan(corpus.keyword_index().docs)


def test_texts_are_encoded_once(spark):
    assert len(re.findall("ArrowEvalPython", _plan(C.encoded_texts(spark, str(DATA))))) == 1


def test_tokens_and_buckets():
    import hashlib

    def plain(text):
        out = []
        for raw in re.findall("[a-zA-Z0-9_]+", text or ""):
            camel = re.sub("([a-z0-9])([A-Z])", r"\1 \2", raw)
            out += [raw, *(filter(None, raw.split("_")) if "_" in raw else ()), *(camel.split(" ") if camel != raw else ())]
        return [x.lower() for x in out]

    texts = [None, "", "_", "One two. Two", "getHTTPServer_v2 a1B2c3", "__init__ x_yZ", "élanVital_été İK aİB", "aB" * 50 + " the the"]
    got = HashedTokens(32)(texts)
    for text, row in zip(texts, got, strict=True):
        assert tokenize(text) == plain(text)
        want = np.zeros(32, np.float32)
        for t in plain(text):
            want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 32] += 1
        assert np.array_equal(row, want / max(np.linalg.norm(want), 1e-30) if want.any() else want)


def test_a_run_encodes_once_and_splits_no_old_text(spark, tmp_path, monkeypatch):
    class Counted:
        def __call__(self, given):
            texts.add(len(given))
            return HashedTokens(8)(given)

    texts, built = spark.sparkContext.accumulator(0), []
    monkeypatch.setattr(bm25, "build", lambda docs, *a, build=bm25.build, **k: built.append(1) or build(docs, *a, **k))
    indexer = Indexer(spark, str(tmp_path / "index"), C.EXAMPLES, encoder=Counted(), blocks=C.document_blocks, calls=C.no_calls)
    rows = [("r", f"f{i}", len(f"some words {i}"), 1.0, "en", f"some words {i}".encode()) for i in range(40)]
    files = spark.createDataFrame(rows, "repo string, file string, size long, mtime double, language string, content binary")
    assert indexer.index(files).chunks == 40 and texts.value == 40
    changed = files.where("file <> 'f7'").withColumn("content", F.when(F.col("file") == "f3", F.encode(F.lit("new words"), "utf-8")).otherwise(F.col("content"))).withColumn("size", F.octet_length("content").cast("long"))
    found = indexer.index(changed)
    assert (found.modified, found.deleted) == (1, 1)
    assert len(built) == 2  # once a run, for its new rows
    fresh = Indexer(spark, str(tmp_path / "anew"), C.EXAMPLES, encoder=HashedTokens(8), blocks=C.document_blocks, calls=C.no_calls)
    fresh.index(changed)
    held = lambda i: (sorted(map(tuple, i.keyword_index().frequencies.where("df <> 0").collect())), i.keyword_index().totals.first(), i.chunks().count())
    assert held(indexer) == held(fresh)
