"""Search over an index: semantic, keyword and hybrid, with optional re-ranking and live snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import code_of_document, line_slice, splitlines
from quern.functions.vectors import quantize_binary, quantize_int8, quantize_ubinary
from quern.operators import bm25, fusion
from quern.operators.models import Scorer, encode_query, rerank
from quern.operators.navigation import count_stored_usages
from quern.operators.vector_search import literal, vector_top_k
from quern.plans.indexing import Indexer
from quern.schema import SEARCH_LIMIT, USAGE_CAP, W_GRAPH

MODES = ("hybrid", "semantic", "keyword")


#: Hits up to which their files are named to the source.
NAMED = 1000


def snippets(hits: DataFrame, files: DataFrame | None) -> DataFrame:
    """Adds code: the lines of the file as it is now, else what the stored document has after its label, else all of it.

    files: repo, file, content and optionally root_order, of which the least wins; a file of the hit's repo goes
    first, and one of any repo will do. Where hits are few, as those of a search are, the search is run here and
    the files are asked for by name, so that a source with filters opens no others.
    """
    stored = code_of_document(F.col("document"))
    if files is None:
        return hits.withColumn("code", stored)
    held = hits.limit(NAMED + 1).collect()
    if len(held) <= NAMED:
        hits = hits.sparkSession.createDataFrame(held, hits.schema)
        names = sorted({r["file"] for r in held if r["file"] is not None})
        files = files.where(F.col("file").isin(names)) if names else files.where("false")
    order = "root_order" if "root_order" in files.columns else None
    lines = files.select(F.col("file"), F.col("repo").alias("__repo"), F.col("content").cast("string").alias("__text"), (F.col(order) if order else F.lit(0)).alias("__order"))
    few = hits.select("id", "file", "repo").distinct()
    best = Window.partitionBy("id").orderBy(F.when(F.col("__repo").eqNullSafe(F.col("repo")), 0).otherwise(1), "__order", "__repo")
    found = lines.join(F.broadcast(few), "file").withColumn("__n", F.row_number().over(best)).where("__n = 1").select("id", "__text")  # `limit` hits
    live = line_slice(splitlines(F.col("__text")), F.col("start_line"), F.col("end_line"))
    return hits.join(found, "id", "left").withColumn("code", F.coalesce(F.nullif(live, F.lit("")), stored)).drop("__text")


def at_hand(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows; if these are few, the search for them is run here, once, and not again for each use of them."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema) if most <= NAMED else rows


def result(hits: DataFrame) -> DataFrame:
    """The columns of a search result, defaults filled in, scores to 4 digits, best first."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return hits.select(
        text("file").alias("file"), F.coalesce("type", F.lit("function")).alias("type"), text("class_chain").alias("class"), text("name").alias("name"),
        F.coalesce("start_line", F.lit(1)).alias("start_line"), F.coalesce("end_line", F.lit(1)).alias("end_line"), F.round("score", 4).alias("score"), "code",
        F.nullif(text("repo"), F.lit("")).alias("repo"), "rank", "id",
    ).orderBy("rank")


class Searcher:
    """Queries over an Indexer's current version. Nothing but the results reaches the driver."""

    def __init__(self, indexer: Indexer, files: DataFrame | None = None, scorer: Scorer | None = None, approximate: bool = False):
        self.indexer, self.files, self.scorer, self.approximate = indexer, files, scorer, approximate

    def vector(self, query: str, limit: int, repo: str | None = None) -> DataFrame:
        """Cosine top-k at the index's precision; the repo filter comes before the search. approximate: by the stored index of vectors."""
        vector = encode_query(query, self.indexer.encoder)
        if self.approximate:
            return self.indexer.near(vector, limit, repo, digits=6)
        rows, ranges = self.indexer.quantized()
        if self.indexer.precision != "float32":
            one = self.indexer.spark.range(1).select(literal(vector).alias("v"))
            code = {"ubinary": quantize_ubinary, "binary": quantize_binary}.get(self.indexer.precision)
            if code is None:
                spread = F.array(*[F.struct(F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi")) for r in ranges]).cast("array<struct<lo: double, hi: double>>")  # none in an empty index
                code = lambda v: quantize_int8(v, spread)
            vector = one.select(code(F.col("v")).alias("v")).first()["v"]
        where = F.col("repo") == repo if repo else None
        return vector_top_k(rows.select("id", "repo", "embedding"), vector, limit=limit, where=where, digits=6).drop("repo")

    def keyword(self, query: str, limit: int, repo: str | None = None) -> DataFrame:
        """BM25 top-k; term statistics are those of all repos."""
        allowed = self.indexer.chunks().where(F.col("repo") == repo) if repo else None
        return bm25.query(self.indexer.keyword_index(), query, limit, allowed)

    def hybrid(self, query: str, limit: int, repo: str | None = None, w_graph: float = W_GRAPH) -> DataFrame:
        """Fuses both lists and a rank by how often each candidate's name is called."""
        _, wide = fusion.widened(limit, False)
        v, k = (at_hand(x, wide) for x in (self.vector(query, wide, repo), self.keyword(query, wide, repo)))
        pool = fusion.pool(v, k).join(self.indexer.chunks().select("id", "name"), "id")
        names = [r[0] for r in pool.select(F.trim("name")).where("trim(name) <> ''").distinct().collect()]  # of at most twice `wide` chunks
        counts = count_stored_usages(self.indexer.symbols(), names, USAGE_CAP).select(F.col("symbol").alias("name"), "n")
        return fusion.fuse(v, k, fusion.graph_ranks(pool, counts), w_graph=w_graph, limit=limit)

    def search(self, query: str, limit: int = SEARCH_LIMIT, mode: str = "hybrid", rerank_hits: bool = False, repo: str | None = None) -> DataFrame:
        """Result rows, best first. Any mode but semantic and keyword is hybrid; an empty index gives no rows."""
        wide, _ = fusion.widened(limit, rerank_hits)
        found = {"semantic": self.vector, "keyword": self.keyword}.get(mode, self.hybrid)(query, wide, repo)
        hits = found.join(self.indexer.chunks().drop("embedding"), "id")
        if rerank_hits:
            hits = rerank(hits, query, self.scorer, limit=limit)
        return result(snippets(hits, self.files))
