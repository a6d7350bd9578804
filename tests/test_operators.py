import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, fusion, incremental
from quern.operators.chunking import chunk_blocks
from quern.operators.models import HashedTokens, TokenOverlap, encode, encode_query, quantize, rerank
from quern.operators.navigation import count_usages, find_definitions, find_usages
from quern.operators.vector_search import vector_top_k
from quern.schema import BLOCKS, CALLS, STATE


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_bm25_scan_and_postings_agree(spark, tmp_path):
    docs = spark.createDataFrame([("id1", "def login(user): pass", "a"), ("id2", "def process_payment(checkout): checkout payment", "b"), ("id3", "", "b")], "id string, document string, repo string")
    scan = bm25.keyword_scan(docs, "checkout payment")
    assert rows(scan, "id", "rank") == [("id2", 1)] and scan.first()["score"] > 0
    bm25.save(bm25.build(docs), str(tmp_path))
    stored = bm25.query(bm25.load(spark, str(tmp_path)), "checkout payment")
    assert rows(stored, "id") == [("id2",)] and abs(stored.first()["score"] - scan.first()["score"]) < 1e-9
    assert bm25.query(bm25.build(docs), "...").count() == 0 and bm25.keyword_scan(docs, "").count() == 0
    assert bm25.query(bm25.build(docs), "payment", allowed=docs.where("repo = 'a'")).count() == 0
    assert bm25.query(bm25.build(docs.where("false")), "payment").count() == 0


def test_fusion(spark):
    v = spark.createDataFrame([("doc1", 1), ("doc2", 2)], "id string, rank int")
    k = spark.createDataFrame([("doc2", 1), ("doc3", 2)], "id string, rank int")
    assert rows(fusion.fuse(v, k), "id")[0] == ("doc2",) and fusion.fuse(v, k).count() == 3
    graph = spark.createDataFrame([("doc2", 1), ("doc1", 100), ("doc9", 1)], "id string, rank int")
    v2 = spark.createDataFrame([("doc1", 1), ("doc2", 2)], "id string, rank int")
    k2 = v2.where("false")
    assert rows(fusion.fuse(v2, k2), "id")[0] == ("doc1",)
    assert rows(fusion.fuse(v2, k2, graph, w_graph=2.0), "id") == [("doc2",), ("doc1",)]
    assert rows(fusion.fuse(v2, k2, graph, w_graph=0.0), "id")[0] == ("doc1",)
    assert fusion.widened(5, False) == (5, 10) and fusion.widened(5, True) == (15, 30)


def test_graph_ranks(spark):
    pool = spark.createDataFrame([("a", " f ", (0, 2)), ("b", "g", (0, 1)), ("c", "f", (1, 1))], "id string, name string, pos struct<list: int, rank: int>")
    counts = spark.createDataFrame([("f", 80), ("z", 3)], "name string, n long")
    assert rows(fusion.graph_ranks(pool, counts).orderBy("rank"), "id", "calls") == [("a", 50), ("c", 50), ("b", 0)]


def block(**x):
    d = dict(repo="", file="s.py", language="python", block_type="function", name="f", class_chain="", start_line=1, end_line=3, code="x", docstring="", block_pos=0) | x
    return tuple(d[c.split()[0]] for c in BLOCKS.split(", "))


def test_chunks(spark):
    lines = [f"    line_{i} = {i} * 2  # a rather long calculation step" for i in range(150)]
    df = spark.createDataFrame([
        block(class_chain="Run", name="go", start_line=10, end_line=11, code="def go(self):\n    return 1"), block(file="big.py", name="huge", end_line=150, code="\n".join(lines), docstring="Heavy."),
        block(file="o.ts", name="p", code="a", block_pos=1), block(file="o.ts", name="p", code="b", block_pos=2), block(file="o.ts", repo="r", name="p", code="b", block_pos=2), block(file="n.py", name="ends", code="\n" * 3000),
    ], BLOCKS)
    got = {r["id"]: r for r in chunk_blocks(df).collect()}
    assert got["s.py::Run::go"]["start_line"] == 10 and got["s.py::Run::go"]["end_line"] == 11
    parts = sorted((r for i, r in got.items() if i.startswith("big.py::huge@part")), key=lambda r: r["start_line"])
    assert len(parts) > 1 and parts[0]["id"].endswith("@part1") and parts[0]["start_line"] == 1 and parts[-1]["end_line"] == 150
    assert all("Docstring: Heavy." in r["document"] for r in parts)
    assert all(b["start_line"] <= a["end_line"] for a, b in zip(parts, parts[1:], strict=False))
    assert got["o.ts::p"]["document"].endswith("a") and got["o.ts::p#2"]["document"].endswith("b") and "r::o.ts::p" in got
    # a text of line ends: windows of empty lines
    assert any(i.startswith("n.py::ends@part") for i in got)


def test_diff_and_tables(spark):
    old = spark.createDataFrame([("", "f1", "h1", 10, 1.0), ("", "f2", "h2", 10, 1.0), ("", "gone", "h", 1, 1.0), ("", "touched", "h4", 5, 1.0)], STATE)
    new = spark.createDataFrame([("", "f1", 10, 1.00001, "never read"), ("", "f2", 11, 2.0, "h2b"), ("", "f3", 3, 1.0, "h3"), ("", "touched", 5, 9.0, "h4")], "repo string, file string, size long, mtime double, sha256 string")
    got = {r["file"]: (r["status"], r["sha256"]) for r in incremental.diff(new, old).collect()}
    assert got == {"f1": ("unchanged", "h1"), "f2": ("modified", "h2b"), "f3": ("added", "h3"), "gone": ("deleted", None), "touched": ("unchanged", "h4")}
    assert incremental.has_changes(incremental.diff(new, old)) and not incremental.has_changes(incremental.diff(new.where("file = 'f1'"), old.where("file = 'f1'")))
    table = spark.createDataFrame([("a", "r", "f1"), ("b", None, "f1"), ("c", "r", "f2")], "id string, repo string, file string")
    assert rows(incremental.delete_files(table, spark.createDataFrame([(None, "f1")], "repo string, file string")).orderBy("id"), "id") == [("a",), ("c",)]
    assert rows(incremental.delete_repo(table, "r"), "id") == [("b",)]
    assert incremental.upsert(table, table.where("id = 'a'").withColumn("file", F.lit("z"))).where("file = 'z'").count() == 1


def calls(spark, *found):
    return spark.createDataFrame([("", f, "python", c, c.replace("::", ".").replace("->", "."), n, c, n) for f, c, n in found], CALLS)


def test_usages_and_definitions(spark):
    c = calls(spark, *[("a.py", "foo", i) for i in range(1, 101)], ("b.py", "x->foo", 1), ("b.py", "Svc::login", 2))
    assert find_usages(c, "foo").count() == 50 and find_usages(c, "foo", 500).count() == 101 and find_usages(c, "  ").count() == 0
    assert rows(find_usages(c, "Svc.login"), "file", "line") == [("b.py", 2)]
    assert dict(rows(count_usages(c, ["foo", "x.foo", "login", "none", "", " "]), "symbol", "n")) == {"foo": 50, "x.foo": 1, "login": 1, "none": 0}
    assert dict(rows(count_usages(c, ["foo"], 10), "symbol", "n")) == {"foo": 10} and count_usages(c, []).count() == 0
    b = spark.createDataFrame([block(name="login", class_chain="Auth"), block(name="login", class_chain="Auth"), block(name="login", repo="two", class_chain="A::Auth"), block(name="logout")], BLOCKS)
    assert find_definitions(b, "login").count() == 2 and find_definitions(b, "Auth::login").count() == 2 and find_definitions(b, "A.Auth.login").count() == 1
    assert find_definitions(b, "login", repo="two").count() == 1 and find_definitions(b, "").count() == 0 and find_definitions(b, "login", 1).count() == 1


def test_models(spark):
    docs = spark.createDataFrame([("a", "parse the token"), ("b", "draw a circle"), ("c", None)], "id string, document string")
    rows_ = encode(docs).cache()
    assert {len(r["embedding"]) for r in rows_.collect()} == {384}
    assert vector_top_k(rows_, encode_query("token parse"), limit=1).first()["id"] == "a"
    codes, ranges = quantize(rows_, "int8")
    assert len(ranges) == 384 and all(-128 <= x <= 127 for r in codes.collect() for x in r["embedding"])
    assert all(len(r["embedding"]) == 48 and all(0 <= x <= 255 for x in r["embedding"]) for r in quantize(rows_, "ubinary")[0].collect())
    with pytest.raises(ValueError):
        quantize(rows_, "int4")
    hits = docs.where("id <> 'c'").withColumn("rank", F.when(F.col("id") == "b", 1).otherwise(2)).withColumn("score", F.lit(0.5))
    assert rows(rerank(hits, "token", limit=2), "id") == [("a",), ("b",)] and rows(rerank(hits, " ", limit=1), "id") == [("b",)]
    assert TokenOverlap()(["a b"], ["b c"]) == [0.5] and HashedTokens(8)(["x"]).shape == (1, 8)


def test_table_functions(spark):
    from quern.operators.extract import register

    register(spark)
    spark.createDataFrame([("python", "def f():\n    g(1)\n"), ("go", None), ("none", "x")], "language string, source string").createOrReplaceTempView("sources")
    assert rows(spark.sql("SELECT b.name, b.start_line, b.end_line FROM sources s, LATERAL extract_blocks(s.language, s.source) b"), "name", "start_line", "end_line") == [("f", 1, 2)]
    assert rows(spark.sql("SELECT c.callee, c.line FROM sources s, LATERAL extract_calls(s.language, s.source) c"), "callee", "line") == [("g", 2)]
