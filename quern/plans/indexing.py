"""Indexing source trees into versioned tables: scan, diff, extract, chunk, encode, add segments, commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import range_arrays
from quern.operators import bm25, incremental, navigation
from quern.operators.chunking import chunk_blocks
from quern.operators.extract import extract_blocks, extract_calls
from quern.operators.bm25 import ranked
from quern.operators.models import PRECISIONS, Encoder, encode, quantize
from quern.operators.vector_search import vector_top_k
from quern.schema import CALLS, CHUNKS, STATE, USAGE_LIMIT
from quern.sources.versions import GONE, Conflict, Version, Versions, file_key, number_of
from quern.sources.workspace import read_workspace, resolve_roots, with_contents

if TYPE_CHECKING:
    from quern.operators.vector_index import VectorIndex

CHUNK_TABLE = CHUNKS + ", embedding array<float>"
CODE_TABLE = "id string, repo string, embedding array<int>, file_key long"
RANGE_TABLE = "ranges array<struct<lo: double, hi: double>>"
#: A chunk's number: the version that it was written for and its place among that version's chunks. Compaction keeps it.
NUMBER = ("since", "doc")
POSTING_TABLE = "since long, " + bm25.STACKED
LENGTH_TABLE = "id string, dl long, file_key long, since long, doc long"
FREQUENCY_TABLE = "term string, df long"
CALL_TABLE = CALLS + ", rev string"
NUMBER_TABLE = "rev string, n long"
FILE_KEYS = ("repo", "file")
VECTORS = "vectors"
#: How often a run starts over after another writer's commit, and the segments of a table from which a run compacts it.
TRIES, SEGMENTS = 5, 16
#: Keys of files that are broadcast at most; the layout of the tables, which a version names.
MANY, LAYOUT = 1 << 20, 2


@dataclass
class IndexStats:
    scanned: int = 0
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    chunks: int = 0
    total: int = 0
    workspaces: list[str] = field(default_factory=list)


class Indexer:
    """Keeps the chunk, call, state and keyword tables of an index folder up to date with its roots.

    Only added and modified files are parsed and encoded, and only their rows are written: a run adds a segment to each
    table, marks of the files whose older rows are gone, and the changes of document frequencies. All of it becomes
    current at once, so a run that is cut off leaves the old version, and repeating it is harmless. Several writers
    can share an index: one that meets another's commit starts over from it. A reader holds the version that it
    began with. State belongs to the index, not to a root.
    """

    def __init__(self, spark: SparkSession, path: str, roots=None, encoder: Encoder | None = None, precision: str = "float32", blocks: Callable[[DataFrame], DataFrame] = extract_blocks, calls: Callable[[DataFrame], DataFrame] = extract_calls):
        self.spark, self.roots, self.encoder, self.precision = spark, resolve_roots(roots), encoder, precision
        self.extract_blocks, self.extract_calls = blocks, calls
        self.store = Versions(spark, path)

    def chunks(self, at: Version | None = None) -> DataFrame:
        return self.store.table(at or self.store.version(), "chunks", CHUNK_TABLE, file_key())

    def calls(self, at: Version | None = None) -> DataFrame:
        return self.store.table(at or self.store.version(), "calls", CALL_TABLE, file_key())

    def state(self, at: Version | None = None) -> DataFrame:
        return self.store.table(at or self.store.version(), "state", STATE, file_key())

    def index(self, files: DataFrame | None = None) -> IndexStats:
        """files: FILES rows to index in place of the roots' trees, of which only files whose size or time is new are opened."""
        for n in range(TRIES):
            base = self.store.version()
            try:
                return self._index(*(self._scan(base) if files is None else (files, files)), base)
            except Conflict:
                if n == TRIES - 1:
                    raise
        raise AssertionError

    def _scan(self, base: Version) -> tuple[DataFrame, DataFrame]:
        """The roots' files with hashes (none where size and time are as they were), and those that may be new with their contents."""
        state = self.state(base)
        listed = read_workspace(self.spark, self.roots, contents=False)
        old = listed.join(incremental.untouched(listed, state), list(FILE_KEYS), "left_semi").withColumn("sha256", F.lit(None).cast("string"))
        opened = with_contents(listed.join(incremental.untouched(listed, state), list(FILE_KEYS), "left_anti").select(*listed.columns), self.roots)
        hashed = opened.withColumn("sha256", F.sha2("content", 256))
        return old.drop("content").unionByName(hashed.drop("content")), opened

    def _index(self, files: DataFrame, contents: DataFrame, base: Version) -> IndexStats:
        seen = incremental.diff(files, self.state(base)).persist()
        try:
            found = incremental.stats(seen).first().asDict()
            out = IndexStats(**found, workspaces=[str(r) for r in self.roots], total=base.numbers.get("chunks", 0))
            if not (out.added or out.modified or out.deleted):
                return out
            fresh = self._fresh(contents, incremental.to_index(seen), out)
            # in order of names: a definition lookup reads the row groups of its name; encoded after that, as finding the ranges computes what is sorted once more
            made = encode(chunk_blocks(self.extract_blocks(fresh), in_order=True), self.encoder).withColumn("doc", F.monotonically_increasing_id())
            changed = incremental.new_state(seen).join(incremental.to_index(seen), list(FILE_KEYS), "left_semi")
            add = {"chunks": made, "calls": navigation.in_order(self.extract_calls(fresh)), "state": changed}
            new = self._change(base, incremental.stale(seen), out.modified + out.deleted, add)
            out.chunks, out.total = new.numbers["made"], new.numbers["chunks"]
        finally:
            seen.unpersist()
        if len(new.tables["chunks"]) > SEGMENTS:
            self.compact()
        self.store.vacuum()
        return out

    @staticmethod
    def _fresh(contents: DataFrame, keys: DataFrame, found: IndexStats) -> DataFrame:
        """The contents of added and modified files. Where all are, none moves; otherwise only those whose hashed key is among the broadcast ones."""
        if not found.unchanged:
            return contents.where(F.col("repo").isNotNull() & F.col("file").isNotNull())
        if found.added + found.modified <= MANY:
            hashed = keys.select(file_key().alias("__key")).distinct()
            contents = contents.withColumn("__key", file_key()).join(F.broadcast(hashed), "__key", "left_semi").drop("__key")
        return contents.join(keys, list(FILE_KEYS), "left_semi")

    def _lengths(self, at: Version) -> DataFrame:
        if at.tables and at.numbers.get("layout") != LAYOUT:
            raise ValueError("the index has an earlier layout: index into a new folder")
        return self.store.table(at, "lengths", LENGTH_TABLE, F.col("file_key"))

    def _postings_of(self, at: Version, lengths: DataFrame) -> DataFrame:
        """The stored postings of some rows of lengths. One bit a chunk is broadcast, in words of 64 of each block, so that no posting moves."""
        words = lengths.select("since", F.shiftright("doc", bm25.BITS).alias("block"), F.shiftright("doc", 6).bitwiseAND((1 << bm25.BITS - 6) - 1).cast("int").alias("n"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc").bitwiseAND(63).cast("int")).alias("bit"))
        words = words.groupBy("since", "block", "n").agg(F.bit_or("bit").alias("bits")).groupBy("since", "block").agg(F.map_from_entries(F.collect_list(F.struct("n", "bits"))).alias("m"))
        words = words.select("since", "block", F.transform(F.sequence(F.lit(0), F.lit((1 << bm25.BITS - 6) - 1)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(0).cast("long"))).alias("__words"))
        among = lambda p: F.call_function("shiftright", F.get("__words", F.shiftright(p["docs"].cast("int"), 6)), p["docs"].bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
        rows = self.store.read(at.tables.get("postings", []), POSTING_TABLE).join(F.broadcast(words), ["since", "block"])
        rows = rows.withColumn("__p", F.filter(F.arrays_zip("docs", "tfs"), among)).where(F.size("__p") > 0)
        return rows.select("since", "term", "block", F.col("__p.docs").alias("docs"), F.col("__p.tfs").alias("tfs"))

    def _change(self, base: Version, stale: DataFrame, n_stale: int, add: dict[str, DataFrame]) -> Version:
        """Commits rows of new files, and the end of stale ones (repo, file)."""
        written: list[str] = []

        def write(name: str, df: DataFrame) -> list[str]:
            written.append(self.store.write(name, df, base))
            return written[-1:]

        try:
            segments = {name: write(name, df) for name, df in add.items()}
            made = self.store.read(segments.get("chunks", []), CHUNK_TABLE + ", doc long")
            if n_stale:
                segments[GONE] = write(GONE, self.store.mark(stale, base))
            if "chunks" in segments:
                index, since = bm25.build(made.withColumns({"chunk": F.col("id"), "file_key": file_key()}), "doc", carry=("chunk", "file_key"), stacked=True), F.lit(base.number + 1).cast("long")
                segments["postings"] = write("postings", index.postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block").withColumn("since", since))
                segments["lengths"] = write("lengths", index.lengths.select(F.col("chunk").alias("id"), "dl", "file_key", since.alias("since"), F.col("id").alias("doc")))
            counts = {"layout": LAYOUT, "made": 0, "chunks": base.numbers.get("chunks", 0), "tokens": base.numbers.get("tokens", 0), GONE: base.numbers.get(GONE, 0) + n_stale}
            deltas = []
            if "chunks" in segments:
                lengths = self.store.read(segments["lengths"], LENGTH_TABLE).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
                counts |= {"made": lengths["n"], "chunks": counts["chunks"] + lengths["n"], "tokens": counts["tokens"] + lengths["t"]}
                deltas.append(bm25.frequencies(self.store.read(segments["postings"], POSTING_TABLE)))
            if n_stale:
                # what goes is counted from its stored postings and lengths; no text is read or split again
                keys = stale.select(file_key().alias("file_key")).distinct()
                ended = self._lengths(base).join(keys, "file_key", "left_semi")
                lengths = ended.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
                counts |= {"chunks": counts["chunks"] - lengths["n"], "tokens": counts["tokens"] - lengths["t"]}
                deltas.append(bm25.frequencies(self._postings_of(base, ended)).select("term", (-F.col("df")).alias("df")))
            delta = deltas[0] if len(deltas) == 1 else deltas[0].unionByName(deltas[1])
            delta = delta.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            segments["frequencies"] = write("frequencies", delta.repartitionByRange("term").sortWithinPartitions("term"))
            numbers = [navigation.symbol_numbers(self.store.read(segments["calls"], CALL_TABLE))] if "calls" in segments else []
            if n_stale:
                gone = navigation.symbol_numbers(incremental.rows_of_files(self.calls(base), stale))
                numbers.append(gone.select("rev", (-F.col("n")).alias("n")))
            delta = numbers[0] if len(numbers) == 1 else numbers[0].unionByName(numbers[1])
            segments["symbols"] = write("symbols", delta.groupBy("rev").agg(F.sum("n").alias("n")).where("n <> 0").repartitionByRange("rev").sortWithinPartitions("rev"))
            codes = self._codes(base, stale if n_stale else None, made if "chunks" in segments else None, segments, write)
            return self.store.commit(base, segments, codes, counts)
        except BaseException:
            self.store.remove(*written)
            raise

    def _codes(self, base: Version, stale: DataFrame | None, made: DataFrame | None, segments: dict[str, list[str]], write) -> dict[str, list[str]]:
        """Codes at the index's precision: those of new rows are added; they are written anew where the ranges change or the precision is new.

        Codes of other precisions would be out of date and go.
        """
        name = f"codes_{self.precision}"
        new: dict[str, list[str]] = {n: [] for n in ("ranges", *(f"codes_{p}" for p in PRECISIONS)) if n in base.tables and n != name and not (n == "ranges" and self.precision == "int8")}
        if self.precision == "float32":
            return new
        slim = lambda df: df.select("id", "repo", "embedding", file_key().alias("file_key"))
        live = self.chunks(base)
        live = incremental.delete_files(live, stale) if stale is not None else live
        live = slim(live).unionByName(slim(made)) if made is not None else slim(live)
        known, same = None, name in base.tables
        if self.precision == "int8":
            new["ranges"] = write("ranges", range_arrays(live, "embedding"))
            known = self.store.read(new["ranges"], RANGE_TABLE)
            same = same and known.first() == self.store.read(base.tables["ranges"], RANGE_TABLE).first()
        code = lambda df: quantize(df, self.precision, known=known)[0].select("id", "repo", "embedding", "file_key")
        if not same:
            new[name] = write(name, code(live))
        elif made is not None:
            segments[name] = write(name, code(slim(made)))
        return new

    def symbols(self, at: Version | None = None) -> DataFrame:
        """rev, n: the call sites of whole symbols, as numbers that add up."""
        return self.store.table(at or self.store.version(), "symbols", NUMBER_TABLE)

    def usages(self, symbol: str, limit: int = USAGE_LIMIT, repo: str | None = None) -> DataFrame:
        """Call sites as they were indexed, from the range of the symbol."""
        return navigation.find_stored_usages(self.calls(), symbol, limit, repo)

    def keyword_index(self, at: Version | None = None) -> bm25.Index:
        """The keyword index goes with its version of the chunks, so it can never be out of date."""
        at = at or self.store.version()
        n, tokens = at.numbers.get("chunks", 0), at.numbers.get("tokens", 0)
        frequencies = self.store.table(at, "frequencies", FREQUENCY_TABLE).groupBy("term").agg(F.sum("df").alias("df"))
        totals = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(tokens / n if n else 0.0).alias("avg_len"))
        lengths = self._lengths(at)
        postings = bm25.unstacked(self.store.read(at.tables.get("postings", []), POSTING_TABLE)).join(lengths.drop("file_key"), list(NUMBER)).select("id", "term", "tf", "dl")
        return bm25.Index(postings, lengths.select("id", "dl"), frequencies, totals)

    def quantized(self) -> tuple[DataFrame, list | None]:
        """Ids, repos and vectors at the index's precision, and the ranges that int8 queries need.

        Codes are those stored; an index opened at a precision it wasn't written at makes them anew.
        """
        at = self.store.version()
        if f"codes_{self.precision}" not in at.tables:
            return quantize(self.chunks(at).select("id", "repo", "embedding"), self.precision)
        codes = self.store.table(at, f"codes_{self.precision}", CODE_TABLE, F.col("file_key")).drop("file_key")
        return codes, self.store.read(at.tables["ranges"], RANGE_TABLE).first()["ranges"] if self.precision == "int8" else None

    def delete_repo(self, repo: str) -> None:
        """Ends all files of a repo."""
        for n in range(TRIES):
            base = self.store.version()
            files = self.state(base).where(F.col("repo").eqNullSafe(F.lit(repo))).select(*FILE_KEYS)
            if not (many := files.count()):
                return
            try:
                self._change(base, files, many, {})
                return
            except Conflict:
                if n == TRIES - 1:
                    raise

    def index_vectors(self) -> VectorIndex:
        """Stores an index of the vectors that there are now; what is indexed later is searched beside it, until the next call."""
        from quern.operators.vector_index import VectorIndex

        for n in range(TRIES):
            base = self.store.version()
            at = self.store.fresh(VECTORS, base)
            made = VectorIndex.build(self.chunks(base).select("id", "repo", "embedding"), f"{self.store.path}/{at}", group_col="repo")
            try:
                self.store.commit(base, replace={VECTORS: [at]})
                return made
            except Conflict:
                self.store.remove(at)
                if n == TRIES - 1:
                    raise
        raise AssertionError

    def near(self, vector: Sequence[float], limit: int, repo: str | None = None, exact: bool = False, digits: int | None = None) -> DataFrame:
        """id, score and rank of the chunks most like a vector, by the stored index and, for rows since then, by a scan.

        exact: what a scan of all vectors gives. Without an index all rows are scanned.
        """
        from quern.operators.vector_index import VectorIndex

        at = self.store.version()
        index = next(iter(at.tables.get(VECTORS, [])), None)
        before = number_of(index) if index else 0
        parts = [[s for s in at.tables.get("chunks", []) if (number_of(s) < before) == old] for old in (True, False)]
        covered, since = (self.chunks(replace(at, tables=at.tables | {"chunks": p})).select("id", "repo", "embedding") for p in parts)
        where = F.col("repo") == repo if repo else None
        found = vector_top_k(since, vector, limit=limit, where=where, digits=digits).drop("repo", "rank")
        if parts[0]:
            stored, wide = VectorIndex(self.spark, f"{self.store.path}/{index}"), limit
            while True:  # some of the best may be gone by now
                hits = stored.search(vector, wide, repo or None, exact, digits=digits).drop("rank").collect()
                ids = [r["id"] for r in hits]
                left = {r["id"] for r in covered.where(F.col("id").isin(ids)).select("id").collect()} if ids else set()
                if len(left) >= limit or len(hits) < wide:
                    break
                wide *= 2
            found = found.unionByName(self.spark.createDataFrame([r for r in hits if r["id"] in left], "id string, score double"))
        return ranked(found, "id", limit)

    def compact(self) -> Version | None:
        """Writes each table as one segment without what is gone; None if another writer came first, whose run will compact."""
        base = self.store.version()
        kinds = {"chunks": CHUNK_TABLE, "calls": CALL_TABLE, "state": STATE, "lengths": LENGTH_TABLE} | {f"codes_{p}": CODE_TABLE for p in PRECISIONS}
        order = {"chunks": ("name", "id"), "calls": ("rev", "repo", "file", "pos")}
        new: dict[str, list[str]] = {GONE: [], VECTORS: []}  # an index of vectors would cover none of the new segments
        for name, kind in kinds.items():
            if name in base.tables:
                rows = self.store.table(base, name, kind, F.col("file_key") if "file_key" in kind else file_key())
                rows = rows.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]) if name in order else rows
                new[name] = [self.store.write(name, rows, base)]
        if "postings" in base.tables:
            by = ("term", "since", "block")
            new["postings"] = [self.store.write("postings", self._postings_of(base, self._lengths(base)).repartitionByRange(*by).sortWithinPartitions(*by), base)]
        if "frequencies" in base.tables:
            rows = self.store.table(base, "frequencies", FREQUENCY_TABLE).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            new["frequencies"] = [self.store.write("frequencies", rows.repartitionByRange("term").sortWithinPartitions("term"), base)]
        if "symbols" in base.tables:
            rows = self.symbols(base).groupBy("rev").agg(F.sum("n").alias("n")).where("n <> 0")
            new["symbols"] = [self.store.write("symbols", rows.repartitionByRange("rev").sortWithinPartitions("rev"), base)]
        try:
            return self.store.commit(base, replace=new, numbers={GONE: 0})
        except Conflict:
            self.store.remove(*[s for found in new.values() for s in found])
            return None


def status_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))
