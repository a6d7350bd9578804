import fnmatch
import io
import json
import os
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from quern import lsp
from quern.api import Workspace
from quern.operators.models import quantize
from quern.plans.indexing import Indexer
from quern.sources.state_documents import export_state, import_state
from quern.sources.workspace import ignore_rules, ignored, is_ignored, read_workspace, resolve_roots
from quern.streaming.watch import debounced, relevant, watch


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan(spark, tmp_path):
    skipped = ("node_modules", "build", ".git", "dist", "__pycache__")
    put(tmp_path, {"a.py": "x = 1", "pkg/__init__.py": "", "b.ts": "1", "c.json": "{}", "nul.py": b"a\x00b", "big.py": "#" * 1_000_001, **{f"{d}/z.py": "y" for d in skipped}})
    assert sorted(r["file"] for r in read_workspace(spark, tmp_path).collect()) == ["a.py", "b.ts", "pkg/__init__.py"]
    put(tmp_path, {".gitignore": "# no\n*.ts\n!index.ts\ngen/\n", "index.ts": "2", "gen/k.py": "3"})
    assert sorted(r["file"] for r in read_workspace(spark, tmp_path).collect()) == ["a.py", "index.ts", "pkg/__init__.py"]


@pytest.mark.parametrize("rules", ["*.py\n!a/keep.py", "gen/", "/x", "src/*.ts", "[ab].go\n!b.go", "doc?/\n*.md"])
def test_ignore_rules_in_columns(spark, rules):
    paths = ["a/keep.py", "b.py", "gen/x.ts", "a/gen/y.go", "x", "a/x", "src/p.ts", "src/q/r.ts", "a.go", "b.go", "docs/a.c", "r.md", "gen"]
    parsed = ignore_rules(rules)
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ignored(F.col("p"), parsed).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == {p: is_ignored(p, parsed) for p in paths}
    assert fnmatch.fnmatch("a/b.py", "*.py")  # a star crosses slashes


def test_roots(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    assert len(resolve_roots()) == 1 and resolve_roots(str(a)) == [a] and resolve_roots([a, b]) == [a, b]
    assert resolve_roots(f"{a}, {b}") == [a, b] and resolve_roots(f"{a};{b}") == [a, b] and resolve_roots(f"{a},{tmp_path / 'none'}") == [a]
    assert len(resolve_roots("no,where")) == 1


FILES = {
    "auth.py": 'def authenticate_user(token):\n    """Check a token."""\n    return token\n\ndef unrelated():\n    pass\n',
    "app.py": "def run():\n    authenticate_user(1)\n    authenticate_user(2)\n    authenticate_user(3)\n",
}


def test_index_search_and_navigate(spark, tmp_path):
    put(tmp_path, FILES)
    w = Workspace(spark, str(tmp_path))
    assert w.semantic_search("anything") == []
    assert [d["name"] for d in w.go_to_definition("authenticate_user")] == ["authenticate_user"]
    first = w.index_workspace()
    assert (first["files_added"], first["chunks_indexed"], first["total_chunks"]) == (2, 3, 3)
    assert w.index_workspace()["chunks_indexed"] == 0
    top = w.semantic_search("check a token to authenticate", 3)
    assert top[0]["name"] == "authenticate_user" and "def authenticate_user" in top[0]["code"] and "repo" not in top[0] and top[0]["class"] == ""
    assert w.semantic_search("authenticate", 1, "keyword")[0]["name"] in ("authenticate_user", "run")
    assert w.semantic_search("authenticate token", 1, "semantic", rerank=True)[0]["name"] == "authenticate_user"
    assert w.semantic_search("authenticate", repo="other") == []
    assert [u["line"] for u in w.find_usages("authenticate_user")] == [2, 3, 4]
    found = json.loads(w.call("go_to_definition", symbol="authenticate_user"))
    assert found["count"] == 1 and found["definitions"][0]["docstring"] == "Check a token."
    # modified, added and deleted files
    put(tmp_path, {"auth.py": "def authenticate_user(t, u):\n    return 1\n", "new.go": "package p\n\nfunc Fresh() int {\n\treturn 1\n}\n"})
    (tmp_path / "app.py").unlink()
    again = w.index_workspace()
    assert (again["files_added"], again["files_modified"], again["files_deleted"], again["chunks_indexed"], again["total_chunks"]) == (1, 1, 1, 2, 2)
    assert w.go_to_definition("run") == [] and w.go_to_definition("Fresh")[0]["language"] == "go"
    assert json.loads(w.call("nothing"))["status"] == "error" and Workspace(spark, str(tmp_path / "none")).index_workspace()["status"] == "error"


def test_stored_codes(spark, tmp_path):
    """Codes go with their version of the chunks, whichever precision wrote it, and equal those made from the vectors."""
    put(tmp_path / "w", FILES)

    def check(i):
        got, ranges = i.quantized()
        want, wanted = quantize(i.chunks(), i.precision)
        assert {r["id"]: r["embedding"] for r in got.collect()} == {r["id"]: r["embedding"] for r in want.collect()} and ranges == wanted
        return sorted(n for n in i.store.version().tables if n.startswith(("codes", "ranges")))

    at = str(tmp_path / "index")
    first = Indexer(spark, at, tmp_path / "w", precision="int8")
    first.index()
    assert check(first) == ["codes_int8", "ranges"]
    assert check(Indexer(spark, at, tmp_path / "w", precision="ubinary")) == ["codes_int8", "ranges"]
    put(tmp_path / "w", {"more.py": "def more(a):\n    return a\n"})
    for precision, names in (("binary", ["codes_binary"]), ("float32", [])):
        other = Indexer(spark, at, tmp_path / "w", precision=precision)
        if precision == "float32":
            (tmp_path / "w/app.py").unlink()
        other.index()
        assert check(other) == names and check(first) == names


def test_several_roots(spark, tmp_path):
    put(tmp_path, {"back/a.py": "def auth_token(x):\n    return x\n", "front/a.py": "def auth_token(y):\n    auth_token(1)\n"})
    w = Workspace(spark, [tmp_path / "back", tmp_path / "front"])
    assert len(w.index_workspace()["workspaces"]) == 2
    assert {h["repo"] for h in w.semantic_search("auth token", 5)} == {"back", "front"}
    assert {h["repo"] for h in w.semantic_search("auth token", 5, repo="front")} == {"front"}
    assert len(w.go_to_definition("auth_token")) == 2 and len(w.go_to_definition("auth_token", repo="back")) == 1
    assert [u["repo"] for u in w.find_usages("auth_token")] == ["front"] and w.find_usages("auth_token", repo="back") == []


def test_watch(spark, tmp_path):
    put(tmp_path / "w", {"a.py": "def a(): pass\n"})
    w, seen = Workspace(spark, tmp_path / "w", str(tmp_path / "index")), []
    q = watch(spark, w.indexer, str(tmp_path / "cp"), seen.append)
    try:
        for n, change in enumerate((lambda: None, lambda: put(tmp_path / "w", {"b.py": "def b(): pass\n"}), lambda: (tmp_path / "w/a.py").unlink())):
            change()
            end = time.time() + 90
            while len(seen) <= n and time.time() < end:
                time.sleep(0.2)
    finally:
        q.stop()
    assert [(s.added, s.deleted, s.total) for s in seen] == [(1, 0, 1), (1, 0, 2), (0, 1, 1)]


def test_stream_pieces(spark):
    df = spark.createDataFrame([("/r/a.py",), ("/r/.git/x.py",), ("/r/n.txt",), ("/q/b.ts",), ("/r/skip.py",), ("/rr/c.py",)], "path string")
    got = relevant(df, ["/r", "/q/"], {"/r": ignore_rules("skip.py")})
    assert sorted((r["root"], r["file"]) for r in got.collect()) == [("/q/", "b.ts"), ("/r", "a.py")]
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,x) AS ts FROM VALUES (0.0), (0.3), (0.6), (2.0) AS t(x)")
    assert sorted(r["n"] for r in debounced(events).collect()) == [1, 3]


def test_state_documents(spark):
    text = '{"version": 1, "files": {"a.py": {"sha256": "h", "size": 3, "mtime": 1.5}, "bad": {"size": "x"}, "worse": 7}}'
    state = import_state(spark, text)
    assert [tuple(r) for r in state.collect()] == [("", "a.py", "h", 3, 1.5)] and json.loads(export_state(state))["files"]["a.py"]["size"] == 3
    assert import_state(spark, "nonsense").count() == 0


SERVER = """
import json, sys
sys.path.insert(0, {root!r})
from quern.lsp import encode, read_message
while (m := read_message(sys.stdin.buffer)) is not None:
    if "id" not in m: continue
    span = {{"start": {{"line": 4, "character": 2}}, "end": {{"line": 4, "character": 5}}}}
    r = {{"textDocument/definition": [{{"uri": "file:///x.py", "range": span}}], "textDocument/hover": {{"contents": [{{"value": "h"}}, "i"]}}}}.get(m["method"], {{}})
    sys.stdout.buffer.write(encode({{"id": m["id"], "result": r}})); sys.stdout.buffer.flush()
"""


def test_language_server_client(tmp_path):
    from helpers import ROOT

    put(tmp_path, {"server.py": SERVER.format(root=str(ROOT)), "x.py": "y"})
    m = lsp.Manager({"python": [sys.executable, str(tmp_path / "server.py")], "go": ["no-such-server"]}, enabled=True)
    c = m.client("python", tmp_path)
    assert c is not None and m.client("python", tmp_path) is c and m.client("go", tmp_path) is None and m.client("elvish", tmp_path) is None
    assert c.definition("x.py", 1, 0) == [{"file": "/x.py", "start_line": 5, "start_character": 2, "end_line": 5, "end_character": 5}]
    assert c.hover("x.py", 1, 0) == "h\ni" and c.definition("none.py", 1, 0) == []
    m.stop()
    assert not c.alive and lsp.Manager(enabled=False).client("python", tmp_path) is None
    assert lsp.read_message(io.BytesIO(lsp.encode({"a": "é"}))) == {"a": "é"} and lsp.read_message(io.BytesIO(b"")) is None
    assert lsp.path_of(lsp.uri_of("/a b/c.py")) == "/a b/c.py" and threading.active_count() >= 1


def test_listing_and_filters(spark, tmp_path):
    """A listing opens nothing; filters on repo and file reach the source, under the rules of a scan; a tree of one folder at the top is many tasks."""
    from quern.sources.workspace import _Reader, content_of, with_contents

    texts = {f"top/d{i}/f{j}.py": f"def f{i}_{j}(): pass\n" for i in range(12) for j in range(3)} | {"top/skip/x.py": "x", "node_modules/y.py": "y", "top/nul.py": "a\x00b", ".gitignore": "skip/\n"}
    put(tmp_path, texts)
    assert len(_Reader([tmp_path], True, 8).partitions()) == 8
    listed = read_workspace(spark, tmp_path, contents=False)
    names = {r["file"] for r in listed.collect()}
    assert names == {n for n in texts if n.startswith("top/d")} | {"top/nul.py"} and listed.where("content is not null").count() == 0
    read = {r["file"]: bytes(r["content"]).decode() for r in with_contents(listed, tmp_path).collect()}
    assert read == {n: t for n, t in texts.items() if n.startswith("top/d")} and read == {r["file"]: bytes(r["content"]).decode() for r in read_workspace(spark, tmp_path).collect()}
    some = read_workspace(spark, tmp_path).where(F.col("file").isin("top/d1/f1.py", "top/skip/x.py", "node_modules/y.py", "top/nul.py", "none.py"))
    assert [r["file"] for r in some.collect()] == ["top/d1/f1.py"]
    reader = _Reader([tmp_path], True, 8)
    from pyspark.sql.datasource import EqualTo

    assert len(list(reader.pushFilters([EqualTo(("file",), "top/d1/f1.py")]))) == 1 and [r[1] for p in reader.partitions() for r in reader.read(p)] == ["top/d1/f1.py"]
    assert content_of(str(tmp_path), "top/nul.py") is None and content_of(str(tmp_path), "none.py") is None


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """Neither a run nor a search opens a file that it doesn't need: its time of access stays."""
    put(tmp_path / "w", FILES | {f"other{i}.py": f"def other{i}(): pass\n" for i in range(6)})
    old = time.time() - 10 * 86_400

    def opened(run):
        for p in (tmp_path / "w").rglob("*.py"):
            os.utime(p, (old, p.stat().st_mtime))
        run()
        return {p.name for p in (tmp_path / "w").rglob("*.py") if p.stat().st_atime > old + 60}

    if not opened(lambda: (tmp_path / "w/other0.py").read_text()):
        pytest.skip("times of access are not kept here")
    w = Workspace(spark, tmp_path / "w", str(tmp_path / "index"))
    assert len(opened(w.index_workspace)) == 8
    assert opened(w.index_workspace) == set()
    put(tmp_path / "w", {"other3.py": "def changed(): pass\n"})
    assert opened(w.index_workspace) == {"other3.py"}
    assert opened(lambda: w.semantic_search("authenticate_user", 1, "keyword")) <= {"auth.py", "app.py"}
    assert opened(lambda: w.go_to_definition("changed")) == {"other3.py"}
