"""Registered queries over source code, indexes, searches and messages.

Sources are the files in `examples`; expected rows are written out, with code and previews cut from the sources by
SQL. Searches run over chunks made from the documents, and SQL computes the same results from the tables.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import sys
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import lsp
from quern.__main__ import log_line
from quern.api import Workspace
from quern.functions import text as T
from quern.operators import bm25, incremental, navigation
from quern.operators.extract import extract_blocks, extract_calls, readable
from quern.operators.models import HashedTokens, encode, encode_query, model_name
from quern.plans.indexing import Indexer
from quern.plans.parallel import spread
from quern.plans.scratch import fresh, remove
from quern.plans.search import Searcher, snippets
from quern.queries import _DOC_TOKENS, _SPLIT, _TOKENS, QUERIES, SQL, _chunks, _chunks_sql, _table, query
from quern.schema import CALLS, FILES, STATE
from quern.sources.state_documents import export_state, import_state
from quern.sources.workspace import ignore_rules, read_workspace, resolve_roots
from quern.streaming.watch import relevant, watch

__all__ = ["OWN", "OWN_SQL", "QUERIES", "SQL"]

#: Over source files, indexes and messages that are written out here: these read no given table, so that they are tests only.
OWN: dict = {}
OWN_SQL: dict[str, str] = {}


def example(sql: str):
    def add(f):
        OWN[f.__name__], OWN_SQL[f.__name__] = f, sql
        return f

    return add


EXAMPLES = Path(__file__).resolve().parent / "examples"


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)


def _values(columns: str, *rows) -> str:
    """Rows as SQL; columns: names with their types."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    cast = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    if not rows:
        return f"SELECT {', '.join(f'NULL::{k} AS {n}' for n, k in zip(names, kinds, strict=True))} WHERE false"
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


def _source(file: str) -> str:
    return (EXAMPLES / file).read_bytes().decode("utf-8", "replace")


def _files(spark: SparkSession, *files: str) -> DataFrame:
    """FILES rows of examples."""
    read = [(f, (EXAMPLES / f).read_bytes()) for f in files]
    return spark.createDataFrame([("", f, len(b), 0.0, None, b) for f, b in read], FILES).withColumn("language", T.language_of(F.col("file")))


# --- definitions and call sites of the twelve languages ---------------------------------------


def _extraction(name: str, file: str, blocks: list[tuple], calls: list[tuple]) -> None:
    """Registers blocks_<name> and calls_<name>. Blocks are (name, class_chain, block_type, first and
    last line, docstring), calls are (callee, line), both in the order of the file."""
    lines = f"(SELECT string_split({_literal(_source(file))}, chr(10)) AS ls)"
    expected = _values("block_pos INTEGER, name VARCHAR, class_chain VARCHAR, block_type VARCHAR, start_line INTEGER, end_line INTEGER, docstring VARCHAR", *((i, *b) for i, b in enumerate(blocks)))
    sql = f"SELECT b.*, array_to_string(ls[start_line:end_line], chr(10)) AS code FROM ({expected}) AS b, {lines}"

    def found(spark, sf_dir):
        return extract_blocks(_files(spark, file)).select("block_pos", "name", "class_chain", "block_type", "start_line", "end_line", "docstring", "code")

    found.__name__ = f"blocks_{name}"
    example(sql)(found)
    expected = _values("pos INTEGER, callee VARCHAR, line INTEGER", *((i, *c) for i, c in enumerate(calls)))
    norm = "replace(replace(trim(callee), '::', '.'), '->', '.')"
    sql = f"SELECT c.*, {norm} AS callee_norm, trim(ls[line], ' ' || chr(9)) AS preview FROM ({expected}) AS c, {lines}"

    def called(spark, sf_dir):
        return extract_calls(_files(spark, file)).select("pos", "callee", "line", "callee_norm", "preview")

    called.__name__ = f"calls_{name}"
    example(sql)(called)


_extraction(
    "python", "sample.py",
    [
        ("top", "", "function", 6, 11, "Docstring of top."), ("decorated", "", "function", 14, 17, ""), ("Outer", "", "class_signature", 20, 21, "Class doc."),
        ("Inner", "Outer", "class_signature", 25, 25, ""), ("deep", "Outer::Inner", "method", 26, 27, ""), ("method", "Outer", "method", 29, 32, ""),
        ("conditional", "", "function", 36, 38, "Raw."), ("tail", "", "function", 41, 41, ""),
    ],
    [
        ("helper", 8), ("os.path.join", 10), ("nested", 11), ("registry.register", 15), ("service.fetch", 17), ("self.a.b().c", 27), ("self.a.b", 27), ("top", 27),
        ("items[0].run", 27), ("check_it", 32), ("Outer().method", 38), ("Outer", 38), ("check_it", 41), ('", ".join', 41),
    ],
)
_extraction(
    "typescript", "client.ts",
    [
        ("Service", "", "class_signature", 1, 2, "/** Service docs */"), ("run", "Service", "method", 3, 6, "/** Runs it. */"), ("helper", "Service", "method", 7, 7, ""),
        ("go", "", "function", 10, 11, "/** Exported */"), ("steps", "", "function", 13, 13, ""), ("twice", "", "function", 15, 15, ""), ("later", "", "function", 16, 18, ""),
        ("bound", "", "function", 19, 19, ""),
    ],
    [("this.helper", 5), ("check_it", 5), ("Inner.Thing", 7), ("check_it", 11), ("q.load", 17)],
)
_extraction("tsx", "card.tsx", [("Card", "", "function", 5, 9, "/** Card */")], [("useLoad", 7), ("open", 8)])
_extraction(
    "javascript", "component.jsx",
    [("Part", "", "function", 3, 5, ""), ("Panel", "", "class_signature", 7, 7, ""), ("show", "Panel", "method", 8, 8, ""), ("make", "Panel", "method", 9, 9, "")],
    [("render", 8), ("Panel", 9)],
)
_extraction(
    "go", "main.go",
    [("Greet", "", "function", 3, 6, "// Greet says hello."), ("Server", "", "class_signature", 8, 11, "// Server serves."), ("Start", "Server", "method", 13, 17, "// Start opens the port.")],
    [("fmt.Sprintf", 5), ("s.loop", 15), ("Greet", 15)],
)
_extraction(
    "rust", "lib.rs",
    [("worker", "", "function", 1, 4, "/// Works."), ("Engine", "", "class_signature", 6, 7, "/// Machine."), ("start", "Engine", "method", 10, 15, "/// Starts.")],
    [("Mod::login", 12), ("self.gear.shift", 13), ("worker", 13)],
)
_extraction(
    "c_sharp", "Auth.cs",
    [("AuthService", "", "class_signature", 3, 5, "/// <summary>Service</summary>"), ("Login", "AuthService", "method", 6, 10, "/// <summary>Login</summary>")],
    [("Session", 8), ("s.Open", 9), ("Check", 9)],
)
_extraction(
    "java", "Account.java",
    [("Account", "", "class_signature", 3, 4, "/** Manager. */"), ("deposit", "Account", "method", 5, 10, "/** Pays. */")],
    [("Ledger.post", 7), ("check", 8), ("Entry", 8), ('"a".concat', 9), ("this.name", 9), ("init", 11)],
)
_extraction("c", "calc.c", [("add", "", "function", 4, 8, "/** Sum */"), ("User", "", "class_signature", 10, 11, "/** User */")], [("log_call", 6), ("ops->plus", 7)])
_extraction(
    "cpp", "db.cpp",
    [("App", "", "class_signature", 1, 1, ""), ("Database", "App", "class_signature", 2, 3, "/** Database */"), ("connect", "App::Database", "method", 5, 9, "/** Opens. */")],
    [("Socket", 7), ("App::open", 8), ("s->handle", 8)],
)
_extraction(
    "kotlin", "User.kt",
    [("Users", "", "class_signature", 1, 2, "/** Users */"), ("find", "Users", "method", 3, 6, "/** Finds. */"), ("short", "Users", "method", 7, 7, "")],
    [("repo.load", 5), ("key", 5), ("names.map", 7), ("check_it", 7)],
)
_extraction(
    "swift", "Auth.swift",
    [("Auth", "", "class_signature", 1, 2, "/// Auth"), ("check", "Auth", "method", 3, 7, "/// Checks.")],
    [("queue.async", 5), ("self.done", 5), ("count", 5), ("store.verify", 6), ("ready", 6)],
)


@example(_values("file VARCHAR, name VARCHAR, start_line INTEGER, end_line INTEGER, code VARCHAR", ("broken.py", "good", 1, 2, "def good():\n    return 1"), ("latin.py", "f", 1, 2, 'def f():\n    return "caf\ufffd"')))
def blocks_of_damaged_files(spark, sf_dir):
    """What stands before an error stays; bytes that are no UTF-8 are replaced; files with a NUL are left out."""
    found = extract_blocks(_files(spark, "broken.py", "latin.py", "binary.py"))
    return found.where("not (file = 'broken.py' and start_line > 2)").select("file", "name", "start_line", "end_line", "code")


# --- usages and definitions -------------------------------------------------------------------

_CODE = ("Account.java", "Auth.cs", "Auth.swift", "User.kt", "calc.c", "card.tsx", "client.ts", "component.jsx", "db.cpp", "lib.rs", "main.go", "sample.py")


@example(_values("file VARCHAR, line INTEGER, preview VARCHAR", ("User.kt", 7, "fun short() = names.map { check_it(it) }"), ("client.ts", 5, "this.helper(`a ${check_it(x)} {`);"), ("client.ts", 11, "export function go(a: number): string { return check_it(a); }")))
def usages_limited(spark, sf_dir):
    """Comments and strings are no usages; the first three by file and place."""
    return navigation.find_usages(extract_calls(_files(spark, *_CODE)), " check_it ", 3).select("file", "line", "preview")


@example(_values("symbol VARCHAR, n BIGINT", ("check_it", 5), ("Mod.login", 1), ("Mod::login", 1), ("login", 1), ("ops->plus", 1), ("handle", 1), ("Inner.Thing", 1), ("none", 0), ("Ledger.post", 1), ("post", 1), ("App::open", 1), ("open", 2)))
def usages_counted(spark, sf_dir):
    wanted = ["check_it", "Mod.login", "Mod::login", "login", "ops->plus", "handle", "Inner.Thing", "none", "Ledger.post", "post", "App::open", "open", "", "  "]
    return navigation.count_usages(extract_calls(_files(spark, *_CODE)), wanted)


@example(_values("symbol VARCHAR, n INTEGER", ("check_it", 2), ("   ", 0)))
def usages_capped(spark, sf_dir):
    calls = extract_calls(_files(spark, *_CODE))
    counted = navigation.count_usages(calls, ["check_it"], 2).select("symbol", F.col("n").cast("int").alias("n"))
    return counted.unionByName(navigation.find_usages(calls, "   ").agg(F.lit("   ").alias("symbol"), F.count("*").cast("int").alias("n")))


@example(_values(
    "symbol VARCHAR, file VARCHAR, name VARCHAR, class_chain VARCHAR, start_line INTEGER", ("check", "Auth.swift", "check", "Auth", 3), ("Users.find", "User.kt", "find", "Users", 3),
    ("Outer::Inner::deep", "sample.py", "deep", "Outer::Inner", 26), ("Inner.deep", "sample.py", "deep", "Outer::Inner", 26), ("Database::connect", "db.cpp", "connect", "App::Database", 5),
))
def definitions_live(spark, sf_dir):
    blocks = extract_blocks(_files(spark, *_CODE))
    each = [navigation.find_definitions(blocks, s).withColumn("symbol", F.lit(s)) for s in ("check", "Users.find", "Outer::Inner::deep", "Inner.deep", "Database::connect", "find.Users", "")]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.select("symbol", "file", "name", "class_chain", "start_line")


@query(f"""WITH {_chunks_sql('doc', 'doc_id % 40')},
d AS (SELECT repo, file, start_line, name, base || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id FROM k WHERE name = 'doc7' AND chain = 'C2'),
f AS (SELECT *, row_number() OVER (PARTITION BY repo, file, start_line, name ORDER BY id) AS n FROM d)
SELECT repo, file, start_line::INTEGER AS start_line, name, id FROM f WHERE n = 1 ORDER BY repo, file, start_line, id LIMIT 20""")
def definitions_indexed(spark, sf_dir):
    """The definitions of a name within a class from stored chunks: one for each repo, file, line and name."""
    return navigation.find_definitions(_chunks(spark, sf_dir, "doc", "doc_id % 40"), "C2::doc7").select("repo", "file", "start_line", "name", "id")


# --- workspaces -------------------------------------------------------------------------------

_SCANNED = [(f, len((EXAMPLES / f).read_bytes())) for f in (*_CODE, "broken.py", "index.mts", "latin.py", "pkg/__init__.py")]


@example(_values("repo VARCHAR, file VARCHAR, size BIGINT, language VARCHAR, sha256 VARCHAR", *[
    ("", f, n, lang, hashlib.sha256((EXAMPLES / f).read_bytes()).hexdigest()) for (f, n), lang in zip(_SCANNED, (
        "java", "c_sharp", "swift", "kotlin", "c", "tsx", "typescript", "javascript", "cpp", "rust", "go", "python", "python", "typescript", "python", "python"), strict=True)
]))
def workspace_scan(spark, sf_dir):
    """Every file but those of other languages, with a NUL, in directories never entered, or under an ignore rule."""
    return read_workspace(spark, EXAMPLES).select("repo", "file", "size", "language", F.sha2("content", 256).alias("sha256"))


@example(_values("repo VARCHAR, files BIGINT", ("examples", 16), ("generated", 1), ("pkg", 1)))
def workspace_roots(spark, sf_dir):
    """Several roots in one text; a rule of one root does not hold for another."""
    roots = f"{EXAMPLES}, {EXAMPLES / 'generated'},{EXAMPLES / 'none'} ,{EXAMPLES / 'pkg'}"
    return read_workspace(spark, resolve_roots(roots)).groupBy("repo").agg(F.count("*").alias("files"))


@example(_values("given VARCHAR, n INTEGER, first VARCHAR", ("one", 1, "examples"), ("commas", 2, "pkg"), ("semicolons", 2, "pkg"), ("list", 2, "generated"), ("some missing", 1, "pkg"), ("none there", 1, "no,where")))
def roots_resolved(spark, sf_dir):
    pkg, gen = str(EXAMPLES / "pkg"), str(EXAMPLES / "generated")
    cases = {"one": str(EXAMPLES), "commas": f"{pkg} , {gen}", "semicolons": f"{pkg};{gen}", "list": [gen, pkg], "some missing": f"{pkg},{EXAMPLES / 'none'}", "none there": "no,where"}
    found = {k: resolve_roots(v) for k, v in cases.items()}
    return spark.createDataFrame([(k, len(v), v[0].name) for k, v in found.items()], "given string, n int, first string")


@example(_values("file VARCHAR", ("ok.py",), ("limit.py",), ("late_nul.go",)))
def readable_files(spark, sf_dir):
    """Up to 1,000,000 bytes, of a known language, without a NUL in the first 8,192 bytes."""
    rows = [("ok.py", 3, b"x=1"), ("limit.py", 1_000_000, b""), ("large.py", 1_000_001, b""), ("nul.py", 9, b"a" * 8191 + b"\0"), ("late_nul.go", 9, b"a" * 8192 + b"\0"), ("notes.toml", 1, b""), ("Makefile", 1, b"")]
    df = spark.createDataFrame([("", f, n, 0.0, None, b) for f, n, b in rows], FILES).withColumn("language", T.language_of(F.col("file")))
    return readable(df).select("file")


@example(_values("path VARCHAR, posix VARCHAR, language VARCHAR", ("src\\a\\B.PY", "src/a/B.PY", "python"), (".hidden", ".hidden", None), ("a.b/c", "a.b/c", None), ("x/y.test.mjs", "x/y.test.mjs", "javascript")))
def relative_paths(spark, sf_dir):
    rows = spark.createDataFrame([("src\\a\\B.PY",), (".hidden",), ("a.b/c",), ("x/y.test.mjs",)], "path string")
    return rows.select("path", T.posix_path(F.col("path")).alias("posix"), T.language_of(T.posix_path(F.col("path"))).alias("language"))


@example(_values("root VARCHAR, file VARCHAR", ("/r", "a.py"), ("/q/", "b.ts"), ("/r", "in/deep.go")))
def watch_relevant(spark, sf_dir):
    """Change events inside a root, of a known language, in no ignored directory and under no ignore rule."""
    paths = ["/r/a.py", "/r/.git/x.py", "/r/n.txt", "/q/b.ts", "/r/skip.py", "/rr/c.py", "/r/in/deep.go", "/r/in/node_modules/y.js", "/q/skip/z.py"]
    events = spark.createDataFrame([(p,) for p in paths], "path string")
    return relevant(events, ["/r", "/q/"], {"/r": ignore_rules("skip.py"), "/q/": ignore_rules("skip/")}).select("root", "file")


# --- state, indexing --------------------------------------------------------------------------

_STATE = '{"version": 1, "files": {"b.py": {"sha256": "h2", "size": 5, "mtime": 2.25}, "a.py": {"sha256": "h", "size": 3, "mtime": 1.5}, "bad": {"size": "x"}, "worse": 7, "half": {"sha256": "h", "size": 1}}}'


@example(_values("document VARCHAR, repo VARCHAR, file VARCHAR, sha256 VARCHAR, size BIGINT, mtime DOUBLE", ("whole", "r", "a.py", "h", 3, 1.5), ("whole", "r", "b.py", "h2", 5, 2.25)))
def state_import(spark, sf_dir):
    """Malformed entries are dropped; a document that is no JSON, or no object, has none."""
    out = import_state(spark, _STATE, "r").withColumn("document", F.lit("whole"))
    for name, text in (("broken", "{"), ("list", "[1]"), ("empty", ""), ("no files", '{"version": 1}')):
        out = out.unionByName(import_state(spark, text, "r").withColumn("document", F.lit(name)))
    return out.select("document", "repo", "file", "sha256", "size", "mtime")


@example(_values("document VARCHAR", (json.dumps({"files": {"a.py": {"mtime": 1.5, "sha256": "h", "size": 3}, "b.py": {"mtime": 2.25, "sha256": "h2", "size": 5}}, "version": 1}, indent=2, sort_keys=True),)))
def state_export(spark, sf_dir):
    return spark.createDataFrame([(export_state(import_state(spark, _STATE)),)], "document string")


def _version(spark: SparkSession, files: dict[str, tuple[str, float]]) -> DataFrame:
    rows = [("", f, len(s.encode()), m, None, s.encode()) for f, (s, m) in files.items()]
    return spark.createDataFrame(rows, FILES).withColumn("language", T.language_of(F.col("file")))


_A, _B = "def a():\n    return b()\n", "def b():\n    pass\n\ndef c():\n    pass\n"
_HISTORY = (
    ("first", {"a.py": (_A, 1.0)}), ("unchanged", {"a.py": (_A, 1.0)}), ("touched", {"a.py": (_A, 7.0)}), ("added", {"a.py": (_A, 7.0), "b.py": (_B, 1.0)}),
    ("modified", {"a.py": (_A + "\ndef d():\n    pass\n", 8.0), "b.py": (_B, 1.0)}), ("deleted", {"b.py": (_B, 1.0)}),
)


@example(_values(
    "step VARCHAR, scanned BIGINT, added BIGINT, modified BIGINT, deleted BIGINT, unchanged BIGINT, chunks BIGINT, total BIGINT, names VARCHAR, calls VARCHAR, state VARCHAR, found VARCHAR",
    ("first", 1, 1, 0, 0, 0, 1, 1, "a", "b", "a.py", "a.py::a"), ("unchanged", 1, 0, 0, 0, 1, 0, 1, "a", "b", "a.py", "a.py::a"), ("touched", 1, 0, 0, 0, 1, 0, 1, "a", "b", "a.py", "a.py::a"),
    ("added", 2, 1, 0, 0, 1, 2, 3, "a,b,c", "b", "a.py,b.py", "a.py::a"), ("modified", 2, 0, 1, 0, 1, 2, 4, "a,b,c,d", "b", "a.py,b.py", "a.py::a"), ("deleted", 1, 0, 0, 1, 1, 0, 2, "b,c", "", "b.py", ""),
))
def index_history(spark, sf_dir):
    """Six runs of one index: what each did, and what its tables, stored state and keyword index (for `return`) then hold."""
    path, rows = fresh(spark, "history"), []
    indexer = Indexer(spark, path, EXAMPLES)
    listed = lambda df, c: ",".join(sorted(r[c] for r in df.select(c).collect()))
    for step, files in _HISTORY:
        s = indexer.index(_version(spark, files))
        rows.append((step, s.scanned, s.added, s.modified, s.deleted, s.unchanged, s.chunks, s.total, listed(indexer.chunks(), "name"), listed(indexer.calls(), "callee"), listed(indexer.state(), "file"), listed(bm25.query(indexer.keyword_index(), "return"), "id")))
    remove(spark, path)
    return spark.createDataFrame(rows, "step string, scanned long, added long, modified long, deleted long, unchanged long, chunks long, total long, names string, calls string, state string, found string")


def document_blocks(files: DataFrame) -> DataFrame:
    """A document is one block."""
    code = F.col("content").cast("string")
    return files.select(
        "repo", "file", "language", F.lit("function").alias("block_type"), F.lit("text").alias("name"), F.lit("").alias("class_chain"), F.lit(1).alias("start_line"), F.size(T.splitlines(code)).alias("end_line"),
        code.alias("code"), F.lit("").alias("docstring"), F.lit(0).alias("block_pos"),
    )


def no_calls(files: DataFrame) -> DataFrame:
    return files.sparkSession.createDataFrame([], CALLS)


@query("""WITH d AS (SELECT source, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE source = 'src3') AS gone, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'fr' AND source <> 'src3') AS changed FROM d)
SELECT unnest(['1 first', '2 again', '3 without src3', '4 French changed', '5 src3 back, French as at first']) AS step, unnest([n, n, n - gone, n - gone, n]) AS scanned, unnest([n, 0, 0, 0, gone]) AS added,
       unnest([0, 0, 0, changed, changed]) AS modified, unnest([0, 0, gone, 0, 0]) AS deleted, unnest([0, n, n - gone, n - gone - changed, n - gone - changed]) AS unchanged, unnest([n, n, n - gone, n - gone, n]) AS files,
       unnest([0, 0, 0, changed, 0]) AS marked FROM s""")
def index_history_of_documents(spark, sf_dir):
    """Five runs of one index over the documents as files: what each found, the files that it then holds, and those in which its keyword index knows a word that only changed files have."""
    path, rows = fresh(spark, "documents"), []
    indexer = Indexer(spark, path, EXAMPLES, encoder=HashedTokens(16), blocks=document_blocks, calls=no_calls)
    docs = _table(spark, sf_dir, "documents").select("source", "lang", F.concat(F.lit("docs/"), "doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" quernstone"))).otherwise(F.col("text")))
    left = lambda df: df.where("source <> 'src3'")
    for step, found in (("1 first", docs), ("2 again", docs), ("3 without src3", left(docs)), ("4 French changed", left(marked)), ("5 src3 back, French as at first", docs)):
        files = found.select(F.col("source").alias("repo"), "file", F.octet_length("text").cast("long").alias("size"), F.lit(1.0).alias("mtime"), F.col("lang").alias("language"), F.encode("text", "utf-8").alias("content"))
        s = indexer.index(files)
        known = indexer.keyword_index().postings.where("term = 'quernstone'").count()
        rows.append((step, s.scanned, s.added, s.modified, s.deleted, s.unchanged, indexer.chunks().select("repo", "file").distinct().count(), known))
    remove(spark, path)
    return spark.createDataFrame(rows, "step string, scanned long, added long, modified long, deleted long, unchanged long, files long, marked long")


@example(_values("kept VARCHAR, n BIGINT", ("after deleting repo one", 1), ("after replay", 2)))
def index_repos(spark, sf_dir):
    """A run that is repeated changes nothing; a repo can be deleted from all tables."""
    path = fresh(spark, "repos")
    indexer = Indexer(spark, path, EXAMPLES)
    files = _version(spark, {"a.py": (_A, 1.0)}).withColumn("repo", F.lit("one"))
    files = files.unionByName(files.withColumn("repo", F.lit("two")))
    indexer.index(files)
    replayed = indexer.index(files).total
    indexer.delete_repo("one")
    left = indexer.chunks().count()
    remove(spark, path)
    return spark.createDataFrame([("after replay", replayed), ("after deleting repo one", left)], "kept string, n long")


@example(_values("precision VARCHAR, width INTEGER, low INTEGER, high INTEGER, first VARCHAR", ("float32", 384, 0, 0, "b.py::b"), ("int8", 384, -128, 127, "b.py::b"), ("ubinary", 48, 0, 255, "b.py::b"), ("binary", 48, -128, 127, "b.py::b")))
def index_precisions(spark, sf_dir):
    """The codes of an index's vectors at each precision, as stored with the index: width, bounds (of the kind), and the best hit for a definition's words."""
    rows = []
    for precision, low, high in (("float32", 0, 0), ("int8", -128, 127), ("ubinary", 0, 255), ("binary", -128, 127)):
        path = fresh(spark, precision)
        indexer = Indexer(spark, path, EXAMPLES, precision=precision)
        indexer.index(_version(spark, {"a.py": (_A, 1.0), "b.py": (_B, 1.0)}))
        codes, _ = indexer.quantized()
        got = codes.select(F.size("embedding").alias("n"), F.array_min("embedding").alias("a"), F.array_max("embedding").alias("b")).collect()
        inside = precision == "float32" or all(low <= r["a"] and r["b"] <= high for r in got)
        first = Searcher(indexer).vector("File b.py Method b Code def b pass", 1).first()["id"]
        rows.append((precision, got[0]["n"] if len({r["n"] for r in got}) == 1 and inside else -1, low, high, first))
        remove(spark, path)
    return spark.createDataFrame(rows, "precision string, width int, low int, high int, first string")


@example(_values("n INTEGER, line VARCHAR", (0, "indexed 1 chunks, 0 files deleted, 1 chunks in all")))
def watch_once(spark, sf_dir):
    """The first pass of a watch over a tree, and the line that it logs."""
    path, said = fresh(spark, "watch"), []
    indexer = Indexer(spark, f"{path}/index", EXAMPLES / "generated")
    watch(spark, indexer, f"{path}/checkpoint", lambda s: said.append(log_line(s)), once=True).awaitTermination()
    remove(spark, path)
    return spark.createDataFrame([(i, x) for i, x in enumerate(said) if x], "n int, line string")


# --- search -----------------------------------------------------------------------------------


@dataclass
class _Corpus:
    """The documents as the chunks of an index, stored once as an index has them, with calls from the line items, for Searcher."""

    spark: SparkSession
    sf_dir: str
    encoder: HashedTokens = field(default_factory=HashedTokens)
    precision: str = "float32"
    paths: list[str] = field(default_factory=list)

    def _store(self, made: DataFrame) -> DataFrame:
        self.paths.append(fresh(self.spark, "corpus"))
        made.write.parquet(self.paths[-1])
        return self.spark.read.schema(made.schema).parquet(self.paths[-1])

    @cached_property
    def stored(self) -> DataFrame:
        return self._store(_chunks(self.spark, self.sf_dir, "doc", "doc_id"))

    def chunks(self) -> DataFrame:
        return encode(self.stored, self.encoder)

    def calls(self) -> DataFrame:
        name = F.concat(F.lit("service.doc"), (F.col("l_partkey") % 90).cast("string"))
        return _table(self.spark, self.sf_dir, "lineitem").select(F.lit("").alias("repo"), name.alias("callee_norm"))

    def symbols(self) -> DataFrame:
        # stored: a search's ranges would be pushed below the counting and split every call's symbol once for each of them
        return self._store(navigation.symbol_numbers(self.calls()))

    def keyword_index(self):
        return bm25.Scan(self.stored)

    def quantized(self):
        return self.chunks(), None

    def files(self) -> DataFrame:
        """A file of today for the repos of even numbers: the first document of each language."""
        d = _table(self.spark, self.sf_dir, "documents").where("cast(substr(source, 4) as int) % 2 = 0")
        first = d.groupBy("source", "lang").agg(F.min_by("text", "doc_id").alias("text"))
        return first.select(F.col("source").alias("repo"), F.concat(F.lit("docs/"), "lang", F.lit(".txt")).alias("file"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))


_SEARCHED = f"""{_chunks_sql('doc', 'doc_id')},
d AS (SELECT base || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id, repo, file, chain, name, code, start_line, end_line,
      'File: ' || file || chr(10) || CASE WHEN chain <> '' THEN 'Class: ' || chain || chr(10) ELSE '' END || 'Method: ' || name || chr(10)
      || CASE WHEN doc <> '' THEN 'Docstring: ' || doc || chr(10) ELSE '' END || 'Code:' || chr(10) || code AS document FROM k),
tk AS (SELECT id, repo, {_TOKENS.format("document")} AS t FROM d),
qt AS (SELECT unnest({_TOKENS.format("'{words}'")}) AS term),
qn AS (SELECT term, count(*) AS times FROM qt GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tk),
pk AS (SELECT id, repo, len(t) AS dl, term, times, len(list_filter(t, lambda x: x = term)) AS tf FROM tk, qn),
fk AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM pk GROUP BY term),
kw AS (SELECT id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM pk JOIN fk USING (term), st WHERE tf > 0 AND {{where}} GROUP BY id),
kr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM kw),
tb AS (SELECT id, repo, (('0x' || substr(md5(term), 1, 8))::BIGINT % 384) AS b, count(*)::DOUBLE AS c FROM (SELECT id, repo, unnest(t) AS term FROM tk) GROUP BY ALL),
qb AS (SELECT (('0x' || substr(md5(term), 1, 8))::BIGINT % 384) AS b, count(*)::DOUBLE AS c FROM qt GROUP BY ALL),
vl AS (SELECT id, sqrt(sum(c * c)) AS l FROM tb GROUP BY id),
vw AS (SELECT tb.id, round(sum(tb.c * coalesce(qb.c, 0)) / (any_value(l) * (SELECT sqrt(sum(c * c)) FROM qb)), 6) AS score FROM tb JOIN vl ON vl.id = tb.id LEFT JOIN qb USING (b) WHERE {{where}} GROUP BY tb.id),
vr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vw),
lf AS (SELECT source AS repo, 'docs/' || lang || '.txt' AS file, arg_min(text, doc_id) AS text FROM documents WHERE substr(source, 4)::INTEGER % 2 = 0 GROUP BY ALL),
ll AS (SELECT repo, file, (SELECT CASE WHEN x[len(x)] = '' THEN x[:len(x) - 1] ELSE x END FROM (SELECT {_SPLIT.replace('code', 'text')} AS x)) AS ls FROM lf),
best AS (SELECT file, ls FROM ll QUALIFY row_number() OVER (PARTITION BY file ORDER BY repo) = 1)"""


def _search_sql(words: str, hits: str, where: str = "true") -> str:
    """hits: SQL for (id, score, rank) of the results, over the common table expressions above."""
    own = "coalesce(ll.ls, best.ls)"
    return f"""WITH {_SEARCHED.replace('{words}', words).replace('{where}', where)}, h AS ({hits})
SELECT h.rank::INTEGER AS rank, d.id, d.file, 'function' AS type, chain AS class, name, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, round(h.score, 4) AS score, d.repo,
       sha256(coalesce(nullif(CASE WHEN {own} IS NOT NULL THEN array_to_string({own}[start_line:end_line], chr(10)) END, ''), code)) AS code_hash
FROM h JOIN d ON d.id = h.id LEFT JOIN ll ON ll.repo = d.repo AND ll.file = d.file LEFT JOIN best ON best.file = d.file"""


def _searched(spark, sf_dir, words, **how) -> DataFrame:
    corpus = _Corpus(spark, sf_dir)
    found = Searcher(corpus, corpus.files()).search(words, **how)
    for path in corpus.paths:  # the few hits are rows of the plan by now
        remove(spark, path)
    return found.select("rank", "id", "file", "type", "class", "name", "start_line", "end_line", "score", "repo", F.sha2(F.col("code").cast("binary"), 256).alias("code_hash"))


_ASKED = "reading thing clown"
_HYBRID = """SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT coalesce(v.id, k.id) AS id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) + coalesce(0.5 / (60 + g.rank), 0) AS score
  FROM (SELECT * FROM vr WHERE rank <= {n}) AS v FULL JOIN (SELECT * FROM kr WHERE rank <= {n}) AS k ON v.id = k.id LEFT JOIN (
    SELECT p.id, row_number() OVER (ORDER BY least(coalesce(c.n, 0), 50) DESC, pos, p.id) AS rank
    FROM (SELECT id, min(pos) AS pos FROM (SELECT id, rank AS pos FROM vr WHERE rank <= {n} UNION ALL SELECT id, 1000 + rank FROM kr WHERE rank <= {n}) GROUP BY id) AS p
    JOIN d ON d.id = p.id LEFT JOIN (SELECT 'doc' || (l_partkey % 90) AS name, count(*) AS n FROM lineitem GROUP BY 1) AS c ON c.name = trim(d.name)) AS g ON g.id = coalesce(v.id, k.id))
QUALIFY rank <= {limit}"""


@query(_search_sql(_ASKED, "SELECT * FROM vr WHERE rank <= 5"))
def search_semantic(spark, sf_dir):
    return _searched(spark, sf_dir, _ASKED, mode="semantic")


@query(_search_sql(_ASKED, "SELECT * FROM kr WHERE rank <= 7"))
def search_keyword(spark, sf_dir):
    return _searched(spark, sf_dir, _ASKED, mode="keyword", limit=7)


@query(_search_sql(_ASKED, _HYBRID.format(n=10, limit=5)))
def search_hybrid(spark, sf_dir):
    return _searched(spark, sf_dir, _ASKED)


@query(_search_sql(_ASKED, _HYBRID.format(n=10, limit=5), "repo = 'src4'"))
def search_of_one_repo(spark, sf_dir):
    """Any other mode is hybrid; the repo filters what may be returned."""
    return _searched(spark, sf_dir, _ASKED, mode="anything", repo="src4")


@query(_search_sql(_ASKED, """SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT tk.id, len(list_intersect(list_distinct(t), (SELECT list(term) FROM qn))) / (SELECT count(*) FROM qn) AS score FROM tk JOIN kr ON kr.id = tk.id WHERE kr.rank <= 15) QUALIFY rank <= 5"""))
def search_reranked(spark, sf_dir):
    return _searched(spark, sf_dir, _ASKED, mode="keyword", rerank_hits=True)


@example(_values("mode VARCHAR, n BIGINT", ("semantic", 0), ("keyword", 0), ("hybrid", 0), ("no words", 0)))
def search_of_nothing(spark, sf_dir):
    """An index with nothing in it, and a keyword search for no words, give no rows."""
    empty = Indexer(spark, fresh(spark, "empty"), EXAMPLES)
    rows = [(m, Searcher(empty).search("anything", mode=m).count()) for m in ("semantic", "keyword", "hybrid")]
    rows.append(("no words", _searched(spark, sf_dir, " ... ", mode="keyword").count()))
    return spark.createDataFrame(rows, "mode string, n long")


@example(_values("id VARCHAR, code VARCHAR", ("own", "two\nthree"), ("other", "dos"), ("first root", "uno\ndos"), ("beyond", "stored"), ("gone", "stored"), ("no label", "plain document"), ("cut", "three")))
def snippets_live(spark, sf_dir):
    """Lines of the file as it is, of the hit's repo before others, of the first root before later ones; else the stored text."""
    files = spark.createDataFrame([("r", "f", b"one\ntwo\r\nthree\n", 1), ("s", "f", b"uno\ndos\ntres\n", 0), ("t", "g", b"g", 2)], "repo string, file string, content binary, root_order int")
    stored = "Method: x\nCode:\nstored"
    hits = [("own", "r", "f", 2, 3, stored), ("other", "s", "f", 2, 2, stored), ("first root", "z", "f", 1, 2, stored), ("beyond", "r", "f", 9, 12, stored), ("gone", "r", "none", 1, 2, stored), ("no label", "r", "none", 1, 1, "plain document"), ("cut", "r", "f", 3, 99, stored)]
    return snippets(spark.createDataFrame(hits, "id string, repo string, file string, start_line int, end_line int, document string"), files).select("id", "code")


@example(_values(
    "tool VARCHAR, answer VARCHAR",
    ("index_workspace", json.dumps({"status": "success", "files_scanned": 16, "files_added": 16, "files_modified": 0, "files_deleted": 0, "chunks_indexed": 45, "total_chunks": 45}, indent=2)),
    ("again", json.dumps({"status": "success", "files_scanned": 16, "files_added": 0, "files_modified": 0, "files_deleted": 0, "chunks_indexed": 0, "total_chunks": 45}, indent=2)),
    ("find_usages", json.dumps({"usages": [{"file": "User.kt", "line": 7, "preview": "fun short() = names.map { check_it(it) }"}, {"file": "client.ts", "line": 5, "preview": "this.helper(`a ${check_it(x)} {`);"}], "count": 2}, indent=2)),
    ("go_to_definition", json.dumps({"definitions": [{"file": "sample.py", "language": "python", "type": "method", "name": "deep", "class": "Outer::Inner", "start_line": 26, "end_line": 27, "code": "        @property\n        def deep(self): return self.a.b().c(top(1), items[0].run(2))", "docstring": ""}], "count": 1}, indent=2)),
    ("semantic_search", json.dumps({"results": [{"file": "User.kt", "type": "method", "class": "Users", "name": "find", "start_line": 3, "end_line": 6}], "count": 1}, indent=2)),
    ("nothing", json.dumps({"status": "error", "message": "no such tool: nothing"}, indent=2)),
    ("no folder", json.dumps({"status": "error"}, indent=2)),
))
def tool_answers(spark, sf_dir):
    """The four tools over the examples, as JSON; a search's score and code are left out here."""
    path = fresh(spark, "tools")
    w = Workspace(spark, str(EXAMPLES), path)
    rows = [("index_workspace", w.call("index_workspace")), ("again", w.call("index_workspace")), ("find_usages", w.call("find_usages", symbol="check_it", limit=2)), ("go_to_definition", w.call("go_to_definition", symbol="Inner.deep"))]
    found = json.loads(w.call("semantic_search", query="repo load key finds", limit=1, mode="keyword"))
    rows.append(("semantic_search", json.dumps(found | {"results": [{k: v for k, v in r.items() if k not in ("score", "code")} for r in found["results"]]}, indent=2)))
    rows += [("nothing", w.call("nothing")), ("no folder", json.dumps({"status": Workspace(spark, str(EXAMPLES / "none"), path).index_workspace()["status"]}, indent=2))]
    remove(spark, path)
    return spark.createDataFrame(rows, "tool string, answer string")


# --- models -----------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, unnest({_DOC_TOKENS}) AS term FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 384)::INTEGER AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round((n::FLOAT / sqrt(sum(n * n) OVER (PARTITION BY doc_id))::FLOAT)::FLOAT::DOUBLE, 6) AS x FROM b""")
def encoded_texts(spark, sf_dir):
    """The default encoder, in batches: unit vectors of 384 dimensions."""
    rows = encode(spread(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))))
    # outer: from an inner one Spark infers a filter on the vectors, for which it encodes all texts a second time, below the exchange
    return rows.select("doc_id", F.posexplode_outer("embedding").alias("bucket", "x")).where("x <> 0").select("doc_id", "bucket", F.round(F.col("x").cast("double"), 6).alias("x"))


@example(_values("bucket INTEGER, x DOUBLE", *[(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 384, x) for t, x in (("parse", 0.8), ("token", 0.6))]))
def encoded_query(spark, sf_dir):
    rows = [(i, round(x, 6)) for i, x in enumerate(encode_query("parse token Parse PARSE TOKEN parse token", HashedTokens())) if x]
    return spark.createDataFrame(rows, "bucket int, x double")


@example(_values("given VARCHAR, variable VARCHAR, name VARCHAR", ("mine", "set", "mine"), (None, "set", "from the environment"), (None, "unset", "default"), ("", "unset", "default")))
def model_names(spark, sf_dir):
    """A model's name: the one given, or an environment variable's, or the default."""
    variable = "QUERN_EXAMPLE_MODEL"
    rows = []
    for given, state in (("mine", "set"), (None, "set"), (None, "unset"), ("", "unset")):
        os.environ.pop(variable, None)
        if state == "set":
            os.environ[variable] = "from the environment"
        rows.append((given, state, model_name(given, variable, "default")))
    os.environ.pop(variable, None)
    return spark.createDataFrame(rows, "given string, variable string, name string")


# --- text of symbols and messages -------------------------------------------------------------


@example(_values("raw VARCHAR, inner_text VARCHAR", ('"""Doc.\n  More. """', "Doc.\n  More."), ("r'x'", "x"), ('Rb"y" ', "y"), ("' z '", "z"), ("plain ", "plain"), ("'open", "'open"), ('""', "")))
def string_literals(spark, sf_dir):
    rows = spark.createDataFrame([('"""Doc.\n  More. """',), ("r'x'",), ('Rb"y" ',), ("' z '",), ("plain ",), ("'open",), ('""',)], "raw string")
    return rows.select("raw", T.strip_string_literal(F.col("raw")).alias("inner_text"))


@example(_values("raw VARCHAR, receiver VARCHAR", ("(s *Server)", "Server"), ("(s Server)", "Server"), ("(*T)", "T"), ("( x  **P )", "P")))
def go_receivers(spark, sf_dir):
    rows = spark.createDataFrame([("(s *Server)",), ("(s Server)",), ("(*T)",), ("( x  **P )",)], "raw string")
    return rows.select("raw", T.go_receiver(F.col("raw")).alias("receiver"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN r_name || '::' ELSE '' END || n_name AS qualified, string_split(replace(r_name || '::' || n_name, '::', '.'), '.')[-1] AS last FROM nation JOIN region ON n_regionkey = r_regionkey")
def qualified_names(spark, sf_dir):
    d = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    chain = F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise("")
    symbol = T.normalize_symbol(F.concat("r_name", F.lit("::"), "n_name"))
    return d.select(F.col("n_nationkey").alias("id"), T.qualified_name(chain, F.col("n_name")).alias("qualified"), T.last_segment(symbol).alias("last"))


@query("SELECT conv_id, turn, 'Content-Length: ' || octet_length(encode(text)) || chr(13) || chr(10) || chr(13) || chr(10) || text AS framed, text AS read FROM (SELECT conv_id, turn, to_json({'role': role, 'n': conv_id})::VARCHAR AS text FROM conversations)")
def messages_framed(spark, sf_dir):
    """JSON bodies framed by their length, and read back from the frames."""
    body = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.col("conv_id").alias("n"))).alias("body"))

    @F.pandas_udf("string")
    def read(frames):
        return frames.map(lambda x: json.dumps(lsp.read_message(io.BytesIO(x.encode())), separators=(",", ":")))

    framed = T.encode_message(F.col("body"))
    return body.select("conv_id", "turn", framed.alias("framed"), read(framed).alias("read"))


@example(_values("uri VARCHAR, path VARCHAR", ("file:///a%20b/c.py", "/a b/c.py"), ("file:///C:/x/y.ts", "C:/x/y.ts"), ("/plain/z.go", "/plain/z.go"), ("file:///p/a+b.c", "/p/a+b.c")))
def uris(spark, sf_dir):
    rows = spark.createDataFrame([("file:///a%20b/c.py",), ("file:///C:/x/y.ts",), ("/plain/z.go",), ("file:///p/a+b.c",)], "uri string")
    return rows.select("uri", T.uri_to_path(F.col("uri")).alias("path"))


_SPAN = '{"start": {"line": 9, "character": 4}, "end": {"line": 14, "character": 2}}'
_ANSWERS = {
    "location": f'{{"uri": "file:///x.py", "range": {_SPAN}}}', "list": f'[{{"uri": "file:///x.py", "range": {_SPAN}}}, {{"uri": "file:///y.py", "range": {_SPAN}}}]',
    "link": f'[{{"targetUri": "file:///z.py", "targetRange": {{"start": {{"line": 0, "character": 0}}, "end": {{"line": 99, "character": 0}}}}, "targetSelectionRange": {_SPAN}}}]',
    "no end": '{"uri": "file:///x.py", "range": {"start": {"line": 9, "character": 4}}}', "no range": '[{"uri": "file:///x.py"}]', "none": "null", "words": '["text", 7]',
}
_FOUND = [(k, f, 10, 4, 15, 2) for k, f in (("location", "/x.py"), ("list", "/x.py"), ("list", "/y.py"), ("link", "/z.py"))] + [("no end", "/x.py", 10, 4, 10, 4)]


@example(_values("answer VARCHAR, file VARCHAR, start_line INTEGER, start_character INTEGER, end_line INTEGER, end_character INTEGER", *_FOUND))
def message_locations(spark, sf_dir):
    """Locations and links of language servers, in columns; a range without its end ends where it starts."""
    rows = spark.createDataFrame(list(_ANSWERS.items()), "answer string, body string")
    return rows.select("answer", F.inline(T.parse_locations(F.col("body"))))


@example(_values("answer VARCHAR, file VARCHAR, start_line INTEGER, start_character INTEGER, end_line INTEGER, end_character INTEGER", *_FOUND))
def message_locations_of_client(spark, sf_dir):
    """The same by the client on the driver."""
    rows = [(k, x["file"], x["start_line"], x["start_character"], x["end_line"], x["end_character"]) for k, body in _ANSWERS.items() for x in lsp.locations(json.loads(body))]
    return spark.createDataFrame(rows, "answer string, file string, start_line int, start_character int, end_line int, end_character int")


@example(_values("body VARCHAR, hover VARCHAR", ('"plain"', "plain"), ('{"kind": "markdown", "value": "**x**"}', "**x**"), ('[{"value": "a"}, "b"]', "a\nb"), ("null", ""), ("{}", "")))
def message_hovers(spark, sf_dir):
    rows = spark.createDataFrame([('"plain"',), ('{"kind": "markdown", "value": "**x**"}',), ('[{"value": "a"}, "b"]',), ("null",), ("{}",)], "body string")
    return rows.select("body", T.hover_text(F.col("body")).alias("hover"))


_SERVER = """
import json, sys
from quern.lsp import encode, read_message
seen = []
while (m := read_message(sys.stdin.buffer)) is not None:
    seen.append(m["method"])
    if "id" not in m: continue
    span = {"start": {"line": 4, "character": 2}, "end": {"line": 4, "character": 5}}
    at = [{"uri": "file:///x.py", "range": span}]
    r = {"textDocument/definition": at, "textDocument/references": at * 2, "textDocument/hover": {"contents": [{"value": "h"}, "i"]}, "seen": seen}.get(m["method"], {})
    if m["method"] == "slow": continue
    sys.stdout.buffer.write(encode({"id": m["id"], "result": r})); sys.stdout.buffer.flush()
"""


@example(_values(
    "step VARCHAR, answer VARCHAR", ("definition", "/x.py:5"), ("references", "/x.py:5 /x.py:5"), ("hover", "h i"), ("unknown file", ""), ("no answer in time", "None"), ("same client", "True"), ("missing binary", "None"),
    ("unknown language", "None"), ("disabled", "None"), ("restarted", "True"), ("stopped", "True"),
    ("messages", "initialize initialized textDocument/didOpen textDocument/definition textDocument/didClose textDocument/didOpen textDocument/references textDocument/didClose textDocument/didOpen textDocument/hover textDocument/didClose slow seen"),
))
def server_session(spark, sf_dir):
    """A client's whole session with a language server of its own, on the driver: answers, order of messages, restart, stop."""
    command = [sys.executable, "-c", f"import sys; sys.path.insert(0, {str(EXAMPLES.parent.parent)!r})\n{_SERVER}"]
    m = lsp.Manager({"python": command, "go": ["no-such-server"]}, enabled=True)
    c = m.client("python", EXAMPLES)
    places = lambda found: " ".join(f"{x['file']}:{x['start_line']}" for x in found)
    rows = [
        ("definition", places(c.definition("sample.py", 1, 0))), ("references", places(c.references("sample.py", 1, 0))), ("hover", c.hover("sample.py", 1, 0).replace("\n", " ")),
        ("unknown file", places(c.definition("none.py", 1, 0))), ("no answer in time", str(c.request("slow", {}, 0.2))), ("same client", str(m.client("python", EXAMPLES) is c)),
        ("missing binary", str(m.client("go", EXAMPLES))), ("unknown language", str(m.client("elvish", EXAMPLES))), ("disabled", str(lsp.Manager(enabled=False).client("python", EXAMPLES))),
        ("messages", " ".join(c.request("seen", {}))),
    ]
    c.process.kill()
    c.process.wait()
    again = m.client("python", EXAMPLES)
    rows.append(("restarted", str(again is not c and again.alive)))
    m.stop()
    rows.append(("stopped", str(not again.alive)))
    return spark.createDataFrame(rows, "step string, answer string")


@example(_values("file VARCHAR, status VARCHAR, sha256 VARCHAR", ("f1", "unchanged", "h1"), ("f2", "modified", "h2b"), ("f3", "added", "h3"), ("gone", "deleted", None), ("touched", "unchanged", "h4")))
def state_diff(spark, sf_dir):
    """Equal size and time (within 0.0001 s) need no hash; the hash decides about the others."""
    old = spark.createDataFrame([("", "f1", "h1", 10, 1.0), ("", "f2", "h2", 10, 1.0), ("", "gone", "h", 1, 1.0), ("", "touched", "h4", 5, 1.0)], STATE)
    new = spark.createDataFrame([("", "f1", 10, 1.00001, "never read"), ("", "f2", 11, 2.0, "h2b"), ("", "f3", 3, 1.0, "h3"), ("", "touched", 5, 9.0, "h4")], "repo string, file string, size long, mtime double, sha256 string")
    return incremental.diff(new, old).select("file", "status", "sha256")
