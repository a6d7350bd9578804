"""Versioned tables: writes in proportion to the change, several writers, readers that keep their version."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators.models import HashedTokens
from quern.operators.vector_search import vector_top_k
from quern.plans import indexing
from quern.plans.indexing import Indexer
from quern.plans.search import Searcher
from quern.schema import BLOCKS, CALLS
from quern.sources.versions import Conflict, Versions, file_key


def blocks(files):
    """A file is one block, named by its first word."""
    code = F.col("content").cast("string")
    made = files.select("repo", "file", F.lit("python").alias("language"), F.lit("function").alias("block_type"), F.element_at(F.split(code, " "), 1).alias("name"), F.lit("").alias("class_chain"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), code.alias("code"), F.lit("").alias("docstring"), F.lit(0).alias("block_pos"))
    return made.to(files.sparkSession.createDataFrame([], BLOCKS).schema)


def calls(files):
    name = F.element_at(F.split(F.col("content").cast("string"), " "), 2)
    made = files.select("repo", "file", F.lit("python").alias("language"), name.alias("callee"), name.alias("callee_norm"), F.lit(1).alias("line"), F.lit("").alias("preview"), F.lit(0).alias("pos"))
    return made.to(files.sparkSession.createDataFrame([], CALLS).schema)


def files(spark, texts):
    rows = [(f"r{len(n) % 3}", n, len(t), float(len(t)), "python", t.encode()) for n, t in texts.items()]
    return spark.createDataFrame(rows, "repo string, file string, size long, mtime double, language string, content binary")


def indexer(spark, path, **more):
    return Indexer(spark, f"file://{path}", [str(path)], encoder=HashedTokens(8), blocks=blocks, calls=calls, **more)


def answers(i):
    """What searches and tables of an index give."""
    found = Searcher(i)
    ranked = lambda df: [(r["id"], round(r["score"], 6), r["rank"]) for r in df.collect()]
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    k = i.keyword_index()
    return {
        "keyword": ranked(found.keyword("red apple tart", 10)), "keyword of a repo": ranked(found.keyword("pear", 10, "r1")), "vector": ranked(found.vector("a tree in the rain", 10)), "hybrid": ranked(found.hybrid("green pear", 5)),
        "chunks": rows(i.chunks(), "id", "document", "content_hash"), "calls": rows(i.calls(), "file", "callee"), "state": rows(i.state(), "repo", "file", "sha256"), "totals": rows(k.totals.select("n", F.round("avg_len", 9).alias("a")), "n", "a"),
        "frequencies": rows(k.frequencies.where("df <> 0"), "term", "df"), "codes": rows(i.quantized()[0].select("id", F.col("embedding").cast("string").alias("e")), "id", "e"),
    }


WORDS = ("apple", "pear", "tart", "tree", "rain", "red", "green")


def text(n, k):
    return f"f{n} g{n % 4} " + " ".join(WORDS[(n * j + k) % 7] for j in range(1, 5 + n % 6))


@pytest.mark.parametrize("precision", ["int8"])
def test_history_equals_a_rebuild(spark, tmp_path, precision, monkeypatch):
    """After changes, before and after compaction, an index is what a new one of the same files is."""
    own = indexer(spark, tmp_path / "own", precision=precision)
    texts = {f"file{'x' * (n % 5)}{n}.py": text(n, 0) for n in range(30)}
    steps = [texts]
    steps.append({**{k: v for i, (k, v) in enumerate(texts.items()) if i % 7}, "new.py": text(77, 2)})
    steps.append({k: v + (" red red" if i % 5 == 0 else "") for i, (k, v) in enumerate(steps[-1].items())})
    for step in steps:
        own.index(files(spark, step))
    fresh = indexer(spark, tmp_path / "fresh", precision=precision)
    fresh.index(files(spark, steps[-1]))
    want = answers(fresh)
    assert answers(own) == want and len(own.store.version().tables["chunks"]) == 3
    assert own.index(files(spark, steps[-1])).chunks == 0 and own.store.version().number == 3
    assert own.compact().number == 4
    assert answers(own) == want and own.store.version().numbers["gone"] == 0 and "gone" not in own.store.version().tables
    own.delete_repo("r1")
    fresh.delete_repo("r1")
    left = answers(own)
    assert left == answers(fresh) and not [r for r in left["state"] if r[0] == "r1"] and left["state"]
    monkeypatch.setattr(indexing, "SEGMENTS", 2)
    for n in range(3):
        own.index(files(spark, {"only.py": text(n, n)}))
    assert len(own.store.version().tables["chunks"]) <= 2 and own.chunks().count() == 1


def size(path: Path) -> int:
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_a_small_change_writes_little(spark, tmp_path):
    """One changed file of 10,000: under 1 % of the index's bytes are written."""
    rows = spark.range(10_000).select(F.lit("r").alias("repo"), F.concat(F.lit("dir/file"), "id", F.lit(".py")).alias("file"), F.concat(F.lit("f"), "id", F.lit(" g "), F.repeat(F.concat(F.lit(" word"), F.xxhash64("id")), 30)).alias("text"))
    shape = lambda df: df.select("repo", "file", F.length("text").cast("long").alias("size"), F.length("text").cast("double").alias("mtime"), F.lit("python").alias("language"), F.col("text").cast("binary").alias("content"))
    own = indexer(spark, tmp_path / "own")
    assert own.index(shape(rows)).added == 10_000
    before = size(tmp_path / "own")
    found = own.index(shape(rows.withColumn("text", F.when(F.col("file") == "dir/file77.py", F.lit("f77 g changed")).otherwise(F.col("text")))))
    assert (found.modified, found.unchanged, found.chunks, found.total) == (1, 9_999, 1, 10_000)
    assert size(tmp_path / "own") - before < before / 100
    assert [r["id"] for r in Searcher(own).keyword("changed", 5).collect()] == ["r::dir/file77.py::f77"]
    assert Searcher(own).keyword("word" + str(spark.range(77, 78).select(F.xxhash64("id")).first()[0]).lstrip("-"), 5).where("id like '%file77.py%'").count() == 0


def test_two_writers(spark, tmp_path):
    """A commit on an old base is refused; runs of two writers that meet both end up in the index."""
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.version().number == 0 and v.table(v.version(), "t", "x long").count() == 0
    base = v.version()
    one, two = v.write("t", spark.range(1), base), v.write("t", spark.range(2), base)
    assert v.commit(base, {"t": [one]}).number == 1
    with pytest.raises(Conflict):
        v.commit(base, {"t": [two]})
    assert v.table(v.version(), "t", "id long").count() == 1 and v.numbers() == [1]
    a, b = indexer(spark, tmp_path / "i"), indexer(spark, tmp_path / "i")
    texts = {f"f{n}.py": text(n, 0) for n in range(6)}
    a.index(files(spark, texts))
    stale = b.store.version()
    a.index(files(spark, texts | {"a.py": text(9, 0)}))
    first, versions = [stale], b.store.version
    b.store.version = lambda *n: first.pop() if first and not n else versions(*n)  # what it read before the other's commit
    done = b.index(files(spark, texts | {"a.py": text(9, 0), "b.py": text(8, 0)}))
    assert not first and (done.added, done.total) == (1, 8) and a.store.version().number == 3
    assert {r["file"] for r in a.chunks().collect()} == {*texts, "a.py", "b.py"}
    results = []
    runs = [threading.Thread(target=lambda i=i, n=n: results.append(i.index(files(spark, texts | {"a.py": text(9, 0), "b.py": text(8, 0), "both.py": text(n, 0)})))) for n, i in enumerate((a, b))]
    [r.start() for r in runs]
    [r.join() for r in runs]
    assert len(results) == 2 and a.chunks().where("file = 'both.py'").count() == 1 and a.chunks().count() == 9


def test_a_reader_keeps_its_version(spark, tmp_path):
    own = indexer(spark, tmp_path / "i")
    own.index(files(spark, {"a.py": text(1, 0), "b.py": text(2, 0)}))
    at = own.store.version()
    held, listed = own.chunks(at), Searcher(own).keyword("apple pear red", 5)
    want = [r["id"] for r in listed.collect()]
    own.index(files(spark, {"b.py": text(3, 0)}))
    own.compact()
    own.store.vacuum(keep=1)  # young files stay
    assert {r["file"] for r in held.collect()} == {"a.py", "b.py"} and [r["id"] for r in listed.collect()] == want
    assert own.chunks(own.store.version(1)).count() == 2 and own.chunks().count() == 1
    segments = lambda: {p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("chunks-")}
    assert len(segments()) == 3 and own.store.vacuum(keep=1, grace=-1) > 0
    assert segments() == set(own.store.version().tables["chunks"]) and own.store.numbers() == [3] and own.chunks().count() == 1


def test_marks_end_earlier_segments_only(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    row = lambda n: spark.createDataFrame([(None, "f", n)], "repo string, file string, n int")
    for n in range(3):
        base = v.version()
        v.commit(base, {"t": [v.write("t", row(n), base)], "gone": [v.write("gone", v.mark(row(0), base), base)]}, numbers={"gone": n + 1})
    read = lambda at: [r["n"] for r in v.table(at, "t", "repo string, file string, n int", file_key()).collect()]
    assert [read(v.version(i)) for i in (1, 2, 3)] == [[0], [1], [2]]


def test_vector_index_and_later_rows(spark, tmp_path):
    """By the stored index, beside rows that came later and without those that are gone: exactly what a scan gives."""
    own = indexer(spark, tmp_path / "i")
    texts = {f"file{n}.py": text(n, n) for n in range(40)}
    found = lambda df: [(r["id"], r["score"], r["rank"]) for r in df.collect()]
    vector = HashedTokens(8)(["green apple tart"])[0].tolist()

    def check():
        want = vector_top_k(own.chunks().select("id", "repo", "embedding"), vector, limit=5, digits=6)
        assert found(own.near(vector, 5, exact=True, digits=6)) == found(want)
        of_repo = vector_top_k(own.chunks().select("id", "repo", "embedding"), vector, limit=5, where=F.col("repo") == "r1", digits=6)
        assert found(own.near(vector, 5, "r1", exact=True, digits=6)) == found(of_repo)
        return [r[0] for r in found(want)]

    own.index(files(spark, texts))
    check()
    assert own.index_vectors().rows == 40
    best = check()
    assert found(Searcher(own, approximate=True).vector("green apple tart", 5)) == found(Searcher(own).vector("green apple tart", 5))
    gone = {i.split("::")[1] for i in best[:3]}
    own.index(files(spark, {k: v for k, v in texts.items() if k not in gone} | {"late.py": "late g1 green apple tart", best[3].split("::")[1]: "other g2 rain"}))
    after = check()
    assert not gone & {i.split("::")[1] for i in after}
    own.compact()
    assert "vectors" not in own.store.version().tables
    check()
