"""Source trees as tables: Python data sources for their files and for changes of them, with ignore rules."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from quern.schema import FILE_BYTES, FILES, IGNORED_DIRS, LANGUAGE_OF, SNIFF_BYTES


def resolve_roots(roots: str | os.PathLike | Sequence[str | os.PathLike] | None = None) -> list[Path]:
    """Roots from a path, a list, or a text with commas or else semicolons between; none is the working directory."""
    if roots is None:
        return [Path.cwd().resolve()]
    if isinstance(roots, str):
        mark = next((m for m in ",;" if m in roots), None)
        if mark:
            listed = [Path(x.strip()) for x in roots.split(mark) if x.strip()]
            folders = [p.resolve() for p in listed if p.is_dir()]
            if folders:
                return folders
        return [Path(roots).resolve()]
    if isinstance(roots, os.PathLike):
        return [Path(roots).resolve()]
    return [Path(r).resolve() for r in roots] or [Path.cwd().resolve()]


# --- ignore rules -------------------------------------------------------------------------


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(kind-marked glob, negated) of each rule line; blank lines and comments are none."""
    lines = [x.strip() for x in text.splitlines()]
    return [(x[1:], True) if x.startswith("!") else (x, False) for x in lines if x and not x.startswith("#")]


def _glob(pattern: str) -> str:
    return fnmatch.translate(pattern)


def rule_patterns(glob: str) -> tuple[list[str], list[str]]:
    """Regular expressions of one rule: for the whole path, and for any of its components.

    A star crosses slashes. A rule that ends in a slash also holds for all that lies below.
    """
    if glob.endswith("/"):
        bare = glob.rstrip("/")
        return [_glob(f"*{bare}/*"), _glob(f"{bare}/*")], [_glob(bare)]
    return [_glob(glob)], [_glob(glob)]


@lru_cache(maxsize=64)
def _compiled(rules: tuple[tuple[str, bool], ...]) -> list[tuple[re.Pattern, re.Pattern, bool]]:
    """Each rule's patterns as two (of the path, of its components), the last rule first."""
    both = lambda patterns: re.compile("|".join(f"(?:{p})" for p in patterns))
    return [(*map(both, rule_patterns(glob)), negated) for glob, negated in reversed(rules)]


def is_ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last rule that matches decides. Rules are compiled once, and looked through from the last."""
    path = path.strip("/")
    parts = path.split("/")
    for whole, each, negated in _compiled(tuple(rules)):
        if whole.match(path) or any(map(each.match, parts)):
            return not negated
    return False


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The same as a column expression, each rule a precompiled pattern."""
    java = lambda p: "^" + re.sub(r"\\[Zz]$", r"\\z", p)
    path = F.regexp_replace(path, "^/+|/+$", "")
    out = F.lit(False)
    for glob, negated in rules:
        whole, each = rule_patterns(glob)
        hit = F.lit(False)
        for p in whole:
            hit |= path.rlike(java(p))
        for p in each:
            hit |= F.exists(F.split(path, "/"), _matches(java(p)))
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def in_ignored_dir(path: Column) -> Column:
    """Whether a path has a component that scans never enter (its file name aside)."""
    folders = F.split(path, "/")
    return F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*map(F.lit, sorted(IGNORED_DIRS))))


# --- scan ---------------------------------------------------------------------------------


def rules_of(root: Path) -> list[tuple[str, bool]]:
    try:
        return ignore_rules((root / ".gitignore").read_text("utf-8", "replace"))
    except OSError:
        return []


def language_by_name(name: str) -> str | None:
    return LANGUAGE_OF.get(os.path.splitext(name)[1].lower())


def entered(folder: str, rules: list[tuple[str, bool]]) -> bool:
    """Whether a scan enters a folder (its path below the root), those above it aside."""
    return folder.rsplit("/", 1)[-1] not in IGNORED_DIRS and not (rules and is_ignored(f"{folder}/", rules))


def taken(path: str, rules: list[tuple[str, bool]]) -> bool:
    """Whether a scan that comes to a file's folder takes the file, by its name."""
    return language_by_name(path) is not None and not (rules and is_ignored(path, rules))


def walk(root: Path, below: str = "", deep: bool = True, rules: list[tuple[str, bool]] | None = None) -> Iterator[tuple[str, os.stat_result]]:
    """(path below the root, stat) of the files that a scan takes by name and size; nothing is opened, and ignored directories are not entered."""
    rules = rules_of(root) if rules is None else rules
    for folder, names, files in os.walk(root / below):
        here = Path(folder).relative_to(root).as_posix()
        prefix = "" if here == "." else f"{here}/"
        names[:] = sorted(n for n in names if entered(prefix + n, rules)) if deep else []
        for name in sorted(files):
            path = prefix + name
            if not taken(path, rules):
                continue
            try:
                stat = os.stat(root / path)
            except OSError:
                continue
            if stat.st_size <= FILE_BYTES:
                yield path, stat


def content_of(root: str, path: str) -> bytes | None:
    """A file's bytes; None if it can't be read or has a NUL in its first bytes."""
    try:
        content = Path(root, path).read_bytes()
    except OSError:
        return None
    return None if b"\x00" in content[:SNIFF_BYTES] else content


class _Part(InputPartition):
    """Folders of roots: (repo, root, folder below it, whether to go down)."""

    def __init__(self, folders: list[tuple[str, str, str, bool]]):
        super().__init__(tuple(folders))
        self.folders = folders


def _repo_name(root: Path, many: bool) -> str:
    return root.name if many else ""


#: Folders that the driver lists at most to deal a tree out, for each task.
LISTED = 4


class _Reader(DataSourceReader):
    """Files of roots, those of some repos and paths alone where a filter says so."""

    def __init__(self, roots: list[Path], contents: bool, tasks: int):
        self.roots, self.contents, self.tasks = [(_repo_name(r, len(roots) > 1), str(r)) for r in roots], contents, max(1, tasks)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In) and f.attribute in (("repo",), ("file",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            yield f  # rows are filtered again

    def partitions(self):
        """Folders dealt out to tasks. Large trees are opened from the top until there are enough folders, each listed once."""
        roots = [(repo, r) for repo, r in self.roots if repo in self.wanted.get("repo", {repo})]
        if "file" in self.wanted:
            files = sorted(f for f in self.wanted["file"] if f)
            return [_Part([(repo, r, f, False) for repo, r in roots for f in files[i :: self.tasks]]) for i in range(min(self.tasks, len(files)))] or [_Part([])]
        open_ = [(repo, r, "") for repo, r in roots if Path(r).is_dir()]
        rules = {r: rules_of(Path(r)) for _, r in roots}
        done, listed = [], 0
        while open_ and len(open_) < LISTED * self.tasks and listed < LISTED * self.tasks:
            repo, r, below = open_.pop(0)
            listed += 1
            done.append((repo, r, below, False))
            try:
                names = sorted(e.name for e in os.scandir(Path(r, below)) if e.is_dir(follow_symlinks=False))
            except OSError:
                continue
            open_ += [(repo, r, path) for n in names if entered(path := f"{below}/{n}".lstrip("/"), rules[r])]
        folders = done + [(*o, True) for o in open_]
        return [_Part(folders[i :: self.tasks]) for i in range(min(self.tasks, len(folders)))] or [_Part([])]

    def _found(self, root: str, below: str, deep: bool):
        rules = rules_of(Path(root))
        if "file" not in self.wanted:
            return walk(Path(root), below, deep, rules)
        above = below.split("/")[:-1]
        if not taken(below, rules) or not all(entered("/".join(above[: i + 1]), rules) for i in range(len(above))):
            return iter(())
        at = Path(root, below)
        try:
            return iter([(below, at.stat())] if at.is_file() and at.stat().st_size <= FILE_BYTES else [])
        except OSError:
            return iter(())

    def read(self, partition: _Part):
        for repo, root, below, deep in partition.folders:
            for path, stat in self._found(root, below, deep):
                content = content_of(root, path) if self.contents else None
                if content is not None or not self.contents:
                    yield repo, path, stat.st_size, stat.st_mtime, language_by_name(path), content


class _ChangeReader(SimpleDataSourceStreamReader):
    """A batch of changed paths whenever there are some since the last look; at first, all paths.

    The offset counts looks at a listing that differs from the one before. What was seen last is kept by the
    reader, so that a restarted query begins with all paths again.
    """

    def __init__(self, roots: list[Path]):
        self.roots, self.seen, self.last = roots, {}, []

    def _listing(self) -> dict[str, tuple]:
        out = {}
        for root in self.roots:
            for folder, names, files in os.walk(root):
                names[:] = sorted(n for n in names if n not in IGNORED_DIRS)
                for name in files:
                    try:
                        s = os.stat(os.path.join(folder, name))
                    except OSError:
                        continue
                    out[Path(folder, name).as_posix()] = (s.st_size, s.st_mtime_ns)
        return out

    def initialOffset(self):
        return {"look": 0}

    def read(self, start):
        now, old = self._listing(), self.seen
        changed = [(p, "modified" if p in old else "added") for p, s in now.items() if old.get(p) != s] + [(p, "deleted") for p in old if p not in now]
        if not changed:
            return iter(()), start
        self.seen, self.last = now, changed
        return iter(changed), {"look": start["look"] + 1}

    def readBetweenOffsets(self, start, end):
        """A batch cut off is given again; after a restart, as all paths there are."""
        return iter(self.last or [(p, "added") for p in self._listing()])

    def commit(self, end):
        pass


class ChangeSource(DataSource):
    """spark.readStream.format("workspace-changes").option("roots", ...): path and change of files, of any kind and rule."""

    @classmethod
    def name(cls):
        return "workspace-changes"

    def schema(self):
        return "path string, change string"

    def simpleStreamReader(self, schema):
        return _ChangeReader(resolve_roots(self.options.get("roots") or self.options.get("path")))


class WorkspaceSource(DataSource):
    """spark.read.format("workspace").option("roots", ...): FILES rows of source trees."""

    @classmethod
    def name(cls):
        return "workspace"

    def schema(self):
        return FILES

    def _roots(self) -> list[Path]:
        return resolve_roots(self.options.get("roots") or self.options.get("path"))

    def reader(self, schema):
        return _Reader(self._roots(), self.options.get("contents", "true").lower() != "false", int(self.options.get("tasks", "1")))


#: Bytes of files that one task reads, about.
TOGETHER = 32 << 20


def read_workspace(spark: SparkSession, roots=None, contents: bool = True) -> DataFrame:
    """repo (the root's name if there are several, else empty), file, size, mtime, language, content.

    Filters on repo and file are pushed: named files are looked up, and no folder is listed. contents=False: files are
    listed and none is opened; content is null, and files with a NUL are listed too (see `with_contents`).
    """
    spark.dataSource.register(WorkspaceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("workspace").option("roots", ",".join(map(str, resolve_roots(roots))))
    return reader.option("contents", str(contents).lower()).option("tasks", str(spark.sparkContext.defaultParallelism)).load()


def with_contents(listed: DataFrame, roots=None) -> DataFrame:
    """Reads the contents of listed files; those that can't be read or have a NUL go. Files are dealt out by their bytes."""
    found = resolve_roots(roots)
    at = {_repo_name(r, len(found) > 1): str(r) for r in found}

    def read(batches):
        for b in batches:
            rows = [r | {"content": content_of(at[r["repo"]], r["file"])} for r in b.to_pylist() if r["repo"] in at]
            for i in range(0, len(rows), 32):
                yield pa.RecordBatch.from_pylist([r for r in rows[i : i + 32] if r["content"] is not None], b.schema)

    size = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cores = listed.sparkSession.sparkContext.defaultParallelism
    parts = max(cores if size > 1 << 20 else 1, -(-size // TOGETHER))
    return listed.repartition(parts, "repo", "file").mapInArrow(read, FILES)
