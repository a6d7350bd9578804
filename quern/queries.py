"""The registered queries over the given tables, and the same results in DuckDB SQL.

The tables hold prose and a star schema, so documents stand for files and blocks, sources for repositories,
hosts for dotted symbols, and so on; `code_queries` has those over source code, indexes and messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.text import (
    content_hash, language_of, line_slice, matches_definition, matches_symbol, normalize_symbol, splitlines, symbol_suffixes, tokenize_code,
)
from quern.operators import bm25, fusion, incremental
from quern.operators.chunking import chunk_blocks
from quern.operators.models import rerank
from quern.operators.navigation import count_stored_usages, count_usages_of, find_stored_usages, find_usages, in_order, symbol_numbers
from quern.operators.vector_index import VectorIndex
from quern.operators.vector_search import hamming_top_k, vector_top_k
from quern.plans.parallel import spread
from quern.plans.scratch import temporary
from quern.sources.workspace import ignore_rules, ignored, in_ignored_dir
from quern.streaming.watch import debounced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tokens and keyword search ------------------------------------------------------------

_TOKENS = r"""flatten(list_transform(list_filter(regexp_split_to_array({0}, '[^a-zA-Z0-9_]+'), lambda r: r <> ''), lambda r: list_transform([r]
    || CASE WHEN contains(r, '_') THEN list_filter(string_split(r, '_'), lambda y: y <> '') ELSE []::VARCHAR[] END
    || CASE WHEN regexp_matches(r, '[a-z0-9][A-Z]') THEN string_split(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ') ELSE []::VARCHAR[] END, lambda z: lower(z))))"""
_DOC_TOKENS = _TOKENS.format("coalesce(text, '')")


@query(f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_distinct FROM (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tokenize_code(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


_IDENTIFIERS = ("AuthService.verify_jwt_token(requestHeader)", "HTTPServer_v2", "a1B2c3", "__init__", "x_yZ", "élanVital_été", "")


@query(
    "WITH s AS (SELECT n_name AS name FROM nation UNION ALL SELECT url FROM pages UNION ALL SELECT unnest(["
    + ", ".join(f"'{x}'" for x in _IDENTIFIERS)
    + f"])) SELECT name, array_to_string({_TOKENS.format('name')}, ' ') AS tokens FROM s"
)
def tokenize_identifiers(spark, sf_dir):
    names = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(_table(spark, sf_dir, "pages").select(F.col("url").alias("name")))
    names = names.unionByName(spark.createDataFrame([(x,) for x in _IDENTIFIERS], "name string"))
    return names.select("name", F.array_join(tokenize_code(F.col("name")), " ").alias("tokens"))


@query(f"SELECT count(*) AS n, round(avg(len({_DOC_TOKENS})), 6) AS avg_len FROM documents")
def bm25_stats(spark, sf_dir):
    d = spread(_table(spark, sf_dir, "documents").select("text")).select(F.size(tokenize_code(F.col("text"))).alias("dl"))
    return bm25.totals(d).select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_DOC_TOKENS}) AS term FROM documents) GROUP BY term")
def bm25_document_frequency(spark, sf_dir):
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_distinct(tokenize_code(F.col("text"))).alias("t"))
    # tokens are distinct within a document, so documents are counted without a second shuffle
    return d.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _bm25_sql(text: str, where: str = "true", limit: int | None = 10) -> str:
    cut = f" ORDER BY score DESC, doc_id LIMIT {limit}" if limit else ""
    terms = ", ".join(f"('{t}')" for t in text.split())
    return f"""WITH d AS (SELECT doc_id, source, {_DOC_TOKENS} AS t FROM documents),
q AS (SELECT term, count(*) AS times FROM (VALUES {terms}) AS v(term) GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
p AS (SELECT doc_id, source, len(t) AS dl, term, times, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM p GROUP BY term),
r AS (SELECT doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
      FROM p JOIN f USING (term), s WHERE tf > 0 AND {where} GROUP BY doc_id),
k AS (SELECT doc_id, score FROM r{cut})
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM k"""


def _keyword(spark, sf_dir, text, where=None, limit=10):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = bm25.keyword_scan(docs, text, "doc_id", "text", None, where).withColumn("score", F.round("score", 6))
    return bm25.ranked(found.select("doc_id", "score"), "doc_id", limit)


_WORDS = "reading thing clown que"


@query(_bm25_sql(_WORDS))
def bm25_topk(spark, sf_dir):
    return _keyword(spark, sf_dir, _WORDS)


@query(_bm25_sql("thing clown thing the"))
def bm25_topk_repeated_terms(spark, sf_dir):
    return _keyword(spark, sf_dir, "thing clown thing the")


@query(_bm25_sql(_WORDS, "source = 'src3'"))
def bm25_source_filter(spark, sf_dir):
    return _keyword(spark, sf_dir, _WORDS, F.col("source") == "src3")


@query(_bm25_sql(_WORDS))
def bm25_postings_topk(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    found = bm25.query(bm25.build(docs), _WORDS, None).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
    return bm25.ranked(found, "doc_id", 10)


# --- vectors ------------------------------------------------------------------------------

_E = "list_transform(embedding, lambda x: x::DOUBLE)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def _cosine_sql(a: str, b: str) -> str:
    return f"{_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}))"


def _vector_sql(where: str = "true", limit: int = 10) -> str:
    return f"""WITH v AS (SELECT vec_id, label, {_E} AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
r AS (SELECT vec_id, round({_cosine_sql("e", "qe")}, 6) AS score FROM v, q WHERE {where}),
k AS (SELECT * FROM r ORDER BY score DESC, vec_id LIMIT {limit})
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM k"""


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings")


def _first_vector(rows: DataFrame, column: str = "embedding") -> list[float]:
    return rows.where("vec_id = 0").select(column).first()[0]


@query(_vector_sql())
def vector_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding")
    return vector_top_k(rows, _first_vector(rows), id_col="vec_id", limit=10, digits=6)


@query(_vector_sql("label = 3"))
def vector_topk_filtered(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vector_top_k(rows, _first_vector(rows), id_col="vec_id", limit=10, where=F.col("label") == 3, digits=6).drop("label")


def _indexed(spark, sf_dir, **how):
    rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows, temporary(spark, "vector-index"), "vec_id", "embedding", "label")
    found = index.search(_first_vector(rows), 10, exact=True, digits=6, **how)
    return found.select(F.col("id").alias("vec_id"), "score", "rank")


@query(_vector_sql())
def vector_index_topk(spark, sf_dir):
    """By a stored index of all vectors; exact, so that its result is the scan's."""
    return _indexed(spark, sf_dir)


@query(_vector_sql("label = 3"))
def vector_index_topk_filtered(spark, sf_dir):
    return _indexed(spark, sf_dir, group="3")


@query(f"SELECT vec_id, unnest(range(len(e)))::INTEGER AS pos, round(unnest(e) / sqrt({_DOT.format('e', 'e')}), 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)")
def l2_normalize(spark, sf_dir):
    tripled = F.transform(V.doubles(F.col("embedding")), lambda x: x * 3)
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.l2_normalize(tripled)).alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


_INT8 = f"""x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest({_E}) AS x FROM embeddings),
g AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM x GROUP BY pos),
c AS (SELECT vec_id, label, pos, CASE WHEN hi > lo THEN least(greatest(floor((x - lo) / ((hi - lo) / 255.0::DOUBLE)) - 128, -128), 127) ELSE 0 END::INTEGER AS code FROM x JOIN g USING (pos))"""


def _int8(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rows.crossJoin(F.broadcast(V.range_arrays(rows, "embedding"))).select("vec_id", V.quantize_int8(F.col("embedding"), F.col("ranges")).alias("code"))


@query(f"WITH {_INT8} SELECT vec_id, pos::INTEGER AS pos, code FROM c")
def quantize_int8(spark, sf_dir):
    return _int8(spark, sf_dir).select("vec_id", F.posexplode("code").alias("pos", "code"))


@query(f"""WITH {_INT8}, v AS (SELECT vec_id, list(code::DOUBLE ORDER BY pos) AS e FROM c GROUP BY vec_id), q AS (SELECT e AS qe FROM v WHERE vec_id = 0),
r AS (SELECT vec_id, round({_cosine_sql("e", "qe")}, 6) AS score FROM v, q), k AS (SELECT * FROM r ORDER BY score DESC, vec_id LIMIT 10)
SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM k""")
def int8_cosine_topk(spark, sf_dir):
    rows = _int8(spark, sf_dir)
    return vector_top_k(rows, _first_vector(rows, "code"), "code", "vec_id", 10, digits=6)


_BYTES = "list_transform(range(8), lambda g: list_sum(list_transform(range(8), lambda i: CASE WHEN embedding[g * 8 + i + 1] > 0 THEN 1 << (7 - i)::INTEGER ELSE 0 END)))"


@query(f"SELECT vec_id, unnest(range(8))::INTEGER AS pos, unnest({_BYTES})::INTEGER AS code FROM embeddings")
def quantize_ubinary(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.quantize_ubinary(F.col("embedding"))).alias("pos", "code"))


@query(f"SELECT vec_id, unnest(range(8))::INTEGER AS pos, (unnest({_BYTES}) - 128)::INTEGER AS code FROM embeddings")
def quantize_binary(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.quantize_binary(F.col("embedding"))).alias("pos", "code"))


@query(f"""WITH v AS (SELECT vec_id, {_BYTES} AS c FROM embeddings), q AS (SELECT c AS qc FROM v WHERE vec_id = 0),
r AS (SELECT vec_id, list_sum(list_transform(list_zip(c, qc), lambda z: bit_count(xor(z[1]::INTEGER, z[2]::INTEGER))))::INTEGER AS distance FROM v, q),
k AS (SELECT * FROM r ORDER BY distance, vec_id LIMIT 10)
SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id)::INTEGER AS rank FROM k""")
def hamming_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", V.quantize_ubinary(F.col("embedding")).alias("code"))
    return hamming_top_k(rows, _first_vector(rows, "code"), "code", "vec_id", 10)


@query(f"""WITH t AS (SELECT doc_id, unnest({_DOC_TOKENS}) AS term FROM documents),
b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 32)::INTEGER AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM b""")
def hashed_embedding(spark, sf_dir):
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(tokenize_code(F.col("text"))).alias("term"))
    bucket = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % 32).cast("int")
    counts = docs.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", F.round(F.col("n") / length, 6).alias("x"))


# --- fusion -------------------------------------------------------------------------------

_LISTS = f"""v AS (SELECT vec_id AS id, score, rank FROM ({_vector_sql(limit=20)})), k AS (SELECT doc_id AS id, score, rank FROM ({_bm25_sql(_WORDS, limit=20)}))"""
_GRAPH = """p AS (SELECT id, min(l * 1000 + rank) AS pos FROM (SELECT id, 0 AS l, rank FROM v UNION ALL SELECT id, 1, rank FROM k) GROUP BY id),
c AS (SELECT p.id, pos, least(count(l_partkey), 50) AS calls FROM p LEFT JOIN lineitem ON l_partkey = p.id GROUP BY p.id, pos),
g AS (SELECT id, row_number() OVER (ORDER BY calls DESC, pos, id) AS rank FROM c)"""


def _rrf_sql(weights: tuple[float, float, float], k: int = 60, graph: bool = False) -> str:
    wv, wk, wg = weights
    more = f" + coalesce({wg} / ({k} + g.rank), 0)" if graph else ""
    return f"""WITH {_LISTS}{", " + _GRAPH if graph else ""},
f AS (SELECT coalesce(v.id, k.id) AS id, round(coalesce({wv} / ({k} + v.rank), 0) + coalesce({wk} / ({k} + k.rank), 0){more}, 6) AS score
      FROM v FULL JOIN k ON v.id = k.id{" LEFT JOIN g ON g.id = coalesce(v.id, k.id)" if graph else ""})
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM f"""


def _lists(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding")
    v = vector_top_k(rows, _first_vector(rows), id_col="vec_id", limit=20, digits=6).withColumnRenamed("vec_id", "id")
    return v, _keyword(spark, sf_dir, _WORDS, limit=20).withColumnRenamed("doc_id", "id")


def _fused(vector, keyword, graph=None, **how):
    found = fusion.fuse(vector, keyword, graph, limit=None, **how).select("id", F.round("score", 6).alias("score"))
    return bm25.ranked(found, "id", None)


@query(_rrf_sql((1.0, 1.0, 0.0)))
def rrf_two_layer(spark, sf_dir):
    return _fused(*_lists(spark, sf_dir))


@query(_rrf_sql((0.3, 2.0, 0.0), 10))
def rrf_weights(spark, sf_dir):
    return _fused(*_lists(spark, sf_dir), k=10, w_vector=0.3, w_keyword=2.0)


@query(_rrf_sql((1.0, 1.0, 0.5), graph=True))
def rrf_three_layer(spark, sf_dir):
    v, k = _lists(spark, sf_dir)
    pool = fusion.pool(v, k).withColumn("name", F.col("id").cast("string"))
    # the calls of a candidate are the line items of its part; those of other parts are left out before counting
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("name"))
    counts = items.join(F.broadcast(pool.select("name")), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    return _fused(v, k, fusion.graph_ranks(pool, counts))


@query("SELECT p_partkey, least(count(l_partkey), 10)::BIGINT AS calls, row_number() OVER (ORDER BY least(count(l_partkey), 10) DESC, p_partkey)::INTEGER AS rank FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey QUALIFY rank <= 100")
def graph_indegree_capped(spark, sf_dir):
    counts = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    parts = _table(spark, sf_dir, "part").select("p_partkey").join(counts, F.col("p_partkey") == F.col("l_partkey"), "left")
    parts = parts.select("p_partkey", F.least(F.coalesce("n", F.lit(0)), F.lit(10)).alias("calls"))
    return bm25.ranked(parts.withColumn("score", F.col("calls")), "p_partkey", 100).drop("score")


@query("""SELECT target, least(count(*), 50)::BIGINT AS calls FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target""")
def link_indegree_capped(spark, sf_dir):
    links = _table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))
    return links.groupBy("target").agg(F.least(F.count("*"), F.lit(50)).alias("calls"))


# --- chunks -------------------------------------------------------------------------------

_SPLIT = r"regexp_split_to_array(code, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_CHUNKS = rf"""b AS (SELECT source AS repo, 'docs/' || lang || '.txt' AS file, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'C' || (doc_id % 5) END AS chain, '{{name}}' || {{id}} AS name,
      CASE WHEN doc_id % 2 = 0 THEN 'about ' || lang ELSE '' END AS doc, coalesce(text, '') AS code, doc_id AS block_pos FROM documents),
l AS (SELECT *, CASE WHEN length(code) > 2048 THEN {_SPLIT} END AS raw FROM b),
m AS (SELECT *, CASE WHEN raw[len(raw)] = '' THEN raw[:len(raw) - 1] ELSE raw END AS ls FROM l),
w AS (SELECT *, len(ls) AS n, greatest(10, 2048 // greatest(1, length(code) // len(ls))) AS win FROM m),
s AS (SELECT *, greatest(1, win - greatest(2, floor(win * 0.15)::BIGINT)) AS step FROM w),
p AS (SELECT *, unnest(CASE WHEN n > 0 THEN range(0, greatest(0, ceil((n - win) / step))::BIGINT + 1) ELSE [-1::BIGINT] END) AS part FROM s),
c AS (SELECT repo, file, chain, name, doc, block_pos, part + 1 AS part, CASE WHEN part >= 0 THEN array_to_string(ls[part * step + 1 : least(n, part * step + win)], chr(10)) ELSE code END AS code,
      CASE WHEN part >= 0 THEN part * step + 1 ELSE 1 END AS start_line, CASE WHEN part >= 0 THEN least(n, part * step + win) ELSE 1 END AS end_line FROM p),
i AS (SELECT *, repo || '::' || file || CASE WHEN chain <> '' THEN '::' || chain ELSE '' END || '::' || name || CASE WHEN part > 0 THEN '@part' || part ELSE '' END AS base FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, file, base ORDER BY block_pos, part) AS nth FROM i)"""


def _chunks_sql(name: str, each: str) -> str:
    return _CHUNKS.replace("{name}", name).replace("{id}", each)


_ID = "base || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id"


def _chunks(spark, sf_dir, name, each="''"):
    d = _table(spark, sf_dir, "documents")
    name = F.concat(F.lit(name), F.expr(each).cast("string"))
    blocks = d.select(
        F.col("source").alias("repo"), F.concat(F.lit("docs/"), "lang", F.lit(".txt")).alias("file"), F.col("lang").alias("language"), F.lit("function").alias("block_type"), name.alias("name"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("doc_id") % 5).cast("string"))).alias("class_chain"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.coalesce("text", F.lit("")).alias("code"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("about "), "lang")).otherwise("").alias("docstring"), F.col("doc_id").alias("block_pos"),
    )
    return chunk_blocks(blocks)


@query(f"WITH {_chunks_sql('doc', 'doc_id')} SELECT {_ID}, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, sha256(code) AS content_hash FROM k")
def chunk_split(spark, sf_dir):
    return _chunks(spark, sf_dir, "doc", "doc_id").select("id", "start_line", "end_line", "content_hash")


@query(
    f"WITH {_chunks_sql('doc', 'doc_id')} SELECT {_ID}, sha256('File: ' || file || chr(10) || CASE WHEN chain <> '' THEN 'Class: ' || chain || chr(10) ELSE '' END || 'Method: ' || name || chr(10)"
    " || CASE WHEN doc <> '' THEN 'Docstring: ' || doc || chr(10) ELSE '' END || 'Code:' || chr(10) || code) AS document_hash FROM k"
)
def chunk_documents(spark, sf_dir):
    return _chunks(spark, sf_dir, "doc", "doc_id").select("id", content_hash(F.col("document")).alias("document_hash"))


@query(f"WITH {_chunks_sql('overload', chr(39) * 2)} SELECT {_ID}, sha256(code) AS content_hash FROM k")
def chunk_ids_repeated(spark, sf_dir):
    return _chunks(spark, sf_dir, "overload").select("id", "content_hash")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("sha256"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").groupBy(content_hash(F.col("text")).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return d.where("n > 1")


@query(r"""SELECT doc_id, nullif(array_to_string((CASE WHEN ls[len(ls)] = '' THEN ls[:len(ls) - 1] ELSE ls END)[2:4], chr(10)), '') AS code
FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM documents)""")
def snippet_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.nullif(line_slice(splitlines(F.col("text")), F.lit(2), F.lit(4)), F.lit("")).alias("code"))


# --- incremental maintenance --------------------------------------------------------------

_NEW = "n AS (SELECT source AS repo, doc_id::VARCHAR AS file, sha256(text) AS sha, length(text)::BIGINT AS size, (1000 + doc_id)::DOUBLE AS mtime FROM documents)"
_OLD = """o AS (SELECT source AS repo, doc_id::VARCHAR AS file, CASE WHEN doc_id % 10 = 1 THEN sha256('old' || text) ELSE sha256(text) END AS sha,
      CASE WHEN doc_id % 10 = 1 THEN length(text) + 1 ELSE length(text) END::BIGINT AS size, CASE WHEN doc_id % 10 = 2 THEN 500 WHEN doc_id % 10 = 3 THEN 1000.00001 + doc_id ELSE 1000 + doc_id END::DOUBLE AS mtime
      FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT source, 'gone' || doc_id, 'x', 1, 1 FROM documents WHERE doc_id % 20 = 5)"""
_DIFF = f"""{_NEW}, {_OLD}, x AS (SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.file, o.file) AS file, CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'deleted'
      WHEN n.size = o.size AND abs(n.mtime - o.mtime) < 1e-4 THEN 'unchanged' WHEN n.sha = o.sha THEN 'unchanged' ELSE 'modified' END AS status,
      CASE WHEN n.file IS NULL THEN NULL WHEN n.size = o.size AND abs(n.mtime - o.mtime) < 1e-4 THEN o.sha ELSE n.sha END AS sha256, n.size, n.mtime FROM n FULL JOIN o ON n.repo = o.repo AND n.file = o.file)"""


def _snapshots(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    i, size = F.col("doc_id"), F.length("text").cast("long")
    files = d.select(F.col("source").alias("repo"), i.cast("string").alias("file"), F.col("text").cast("binary").alias("content"), size.alias("size"), (1000 + i).cast("double").alias("mtime"))
    odd = i % 10 == 1
    old = d.where(i % 10 != 0).select(
        F.col("source").alias("repo"), i.cast("string").alias("file"), F.when(odd, content_hash(F.concat(F.lit("old"), "text"))).otherwise(content_hash(F.col("text"))).alias("sha256"), F.when(odd, size + 1).otherwise(size).alias("size"),
        F.when(i % 10 == 2, 500.0).when(i % 10 == 3, 1000.00001 + i).otherwise((1000 + i).cast("double")).alias("mtime"),
    )
    gone = d.where(i % 20 == 5).select(F.col("source").alias("repo"), F.concat(F.lit("gone"), i.cast("string")).alias("file"), F.lit("x").alias("sha256"), F.lit(1).cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    return files, old.unionByName(gone)


@query(f"WITH {_DIFF} SELECT * FROM x")
def incremental_diff(spark, sf_dir):
    return incremental.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT repo, file, sha256, size, mtime FROM x WHERE status <> 'deleted'")
def incremental_state(spark, sf_dir):
    return incremental.new_state(incremental.diff(*_snapshots(spark, sf_dir)))


@query(f"WITH {_DIFF} SELECT count(*) FILTER (WHERE status <> 'deleted') AS scanned, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'deleted') AS deleted, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM x")
def index_stats(spark, sf_dir):
    return incremental.stats(incremental.diff(*_snapshots(spark, sf_dir)))


@query(f"WITH {_DIFF} SELECT o.repo, o.file, o.sha FROM o JOIN x ON o.repo = x.repo AND o.file = x.file WHERE x.status NOT IN ('modified', 'deleted')")
def incremental_delete(spark, sf_dir):
    files, old = _snapshots(spark, sf_dir)
    kept = incremental.delete_files(old, incremental.stale(incremental.diff(files, old)))
    return kept.select("repo", "file", F.col("sha256").alias("sha"))


@query("""WITH n AS (SELECT o_orderkey AS id, o_orderstatus AS status, -o_totalprice AS price FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT -o_orderkey, 'new', 0 FROM orders WHERE o_orderkey % 11 = 0)
SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def incremental_upsert(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = old.where("id % 7 = 0").withColumn("price", -F.col("price")).unionByName(old.where("id % 11 = 0").select((-F.col("id")).alias("id"), F.lit("new").alias("status"), F.lit(0.0).alias("price")))
    return incremental.upsert(old, new)


@query("SELECT * FROM supplier WHERE s_nationkey <> 3 OR s_nationkey IS NULL")
def delete_by_repo(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    return incremental.delete_repo(s.withColumn("repo", F.col("s_nationkey").cast("string")), "3").drop("repo")


# --- symbols ------------------------------------------------------------------------------

_HOST = r"regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_HOST_CALLS = f"c AS (SELECT {_HOST} AS callee FROM pages)"
_SUFFIXES = "s AS (SELECT array_to_string(p[unnest(range(1, len(p) + 1)):], '.') AS symbol FROM (SELECT string_split(callee, '.') AS p FROM c))"


def _host_calls(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    p = _table(spark, sf_dir, "pages")
    return p.select(F.lit("").alias("repo"), F.col("url").alias("file"), normalize_symbol(host).alias("callee_norm"), F.col("page_id").cast("int").alias("line"), F.col("url").alias("preview"), F.col("page_id").cast("int").alias("pos"))


@query(f"WITH {_HOST_CALLS}, {_SUFFIXES} SELECT symbol, count(*) AS n FROM s GROUP BY symbol")
def symbol_suffix_counts(spark, sf_dir):
    calls = _host_calls(spark, sf_dir)
    return calls.select(F.explode(symbol_suffixes(F.col("callee_norm"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


_SYMBOLS = ("example.com", "example::net", "org", "example->com", "no_such.symbol", " com ")


@query(
    f"WITH {_HOST_CALLS}, {_SUFFIXES}, q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _SYMBOLS) + "]) AS symbol)"
    " SELECT q.symbol, least(count(s.symbol), 50)::BIGINT AS n FROM q LEFT JOIN s ON s.symbol = replace(replace(trim(q.symbol), '::', '.'), '->', '.') GROUP BY q.symbol"
)
def symbol_batch_counts(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in _SYMBOLS], "symbol string").withColumn("norm", normalize_symbol(F.col("symbol")))
    return count_usages_of(_host_calls(spark, sf_dir), names)


@query(
    f"WITH {_HOST_CALLS}, {_SUFFIXES}, q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in _SYMBOLS) + "]) AS symbol)"
    " SELECT q.symbol, least(count(s.symbol), 50)::BIGINT AS n FROM q LEFT JOIN s ON s.symbol = replace(replace(trim(q.symbol), '::', '.'), '->', '.') GROUP BY q.symbol"
)
def symbol_batch_counts_stored(spark, sf_dir):
    """From the numbers of whole symbols, of which only the ranges of the wanted ones are read."""
    return count_stored_usages(symbol_numbers(_host_calls(spark, sf_dir)), _SYMBOLS)


@query(f"SELECT NULL::VARCHAR AS repo, url AS file, page_id::INTEGER AS line, url AS preview FROM pages WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' ORDER BY url, page_id LIMIT 50")
def symbol_usages(spark, sf_dir):
    return find_usages(_host_calls(spark, sf_dir), "example::org").withColumn("repo", F.nullif("repo", F.lit("")))


@query(f"SELECT NULL::VARCHAR AS repo, url AS file, page_id::INTEGER AS line, url AS preview FROM pages WHERE {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' ORDER BY url, page_id LIMIT 50")
def symbol_usages_stored(spark, sf_dir):
    """From calls that are stored in the order of their symbols read from the end."""
    path = temporary(spark, "calls")
    in_order(_host_calls(spark, sf_dir)).write.parquet(path)
    return find_stored_usages(spark.read.parquet(path), "example::org").withColumn("repo", F.nullif("repo", F.lit("")))


@query(f"SELECT page_id FROM pages WHERE {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com'")
def symbol_match(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    return p.where(matches_symbol(normalize_symbol(F.col("host")), "example::com")).select("page_id")


@query("""WITH d AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'World::' || r_name ELSE '' END AS chain, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT id, name, chain FROM d WHERE name = 'NATION_4' AND chain <> '' AND (chain = r_name OR chain LIKE '%::' || r_name) UNION ALL SELECT id, name, chain FROM d WHERE name = 'NATION_7'""")
def definition_match(spark, sf_dir):
    d = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    chain = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("World::"), "r_name")).otherwise("")
    d = d.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), chain.alias("chain"), "r_name")
    region = d.where("name = 'NATION_4'").select("r_name").first()["r_name"]
    both = [d.where(matches_definition(F.col("name"), F.col("chain"), t)) for t in (f"{region}::NATION_4", "NATION_7")]
    return both[0].unionByName(both[1]).select("id", "name", "chain")


# --- paths, sessions, ranking -------------------------------------------------------------

_PATHS = ("py", "TS", "mts", "tsx", "jsx", "go", "rs", "cs", "java", "h", "hpp", "kts", "swift", "toml", "json", "")
_PATH_SQL = "regexp_replace(url, '^[a-z]+://', '') || CASE (page_id % 16)::INTEGER " + " ".join(f"WHEN {i} THEN '{'/f.' + e if e else ''}'" for i, e in enumerate(_PATHS)) + " END"


def _paths(spark, sf_dir):
    ends = F.array(*[F.lit(f"/f.{e}" if e else "") for e in _PATHS])
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.element_at(ends, (F.col("page_id") % 16 + 1).cast("int"))).alias("path"))


@query(
    f"SELECT page_id, CASE WHEN page_id % 16 = 15 THEN NULL ELSE ([{', '.join(repr(x) if x else 'NULL' for x in ('python', 'typescript', 'typescript', 'tsx', 'javascript', 'go', 'rust', 'c_sharp', 'java', 'c', 'cpp', 'kotlin', 'swift', None, None, None))}])[page_id % 16 + 1] END AS language FROM pages"
)
def language_routing(spark, sf_dir):
    found = _paths(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 16 != 15, language_of(F.col("path"))).alias("language"))
    return found


@query(f"""WITH p AS (SELECT page_id, trim({_PATH_SQL}, '/') AS path FROM pages),
s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, CASE WHEN path = 'f.py' OR len(list_filter(parts, lambda x: x = 'f.py')) > 0 THEN false
  WHEN len(list_filter(parts, lambda x: x = 'en')) > 0 OR path LIKE '%en/%' THEN true
  WHEN path LIKE '%.py' OR len(list_filter(parts, lambda x: x LIKE '%.py')) > 0 OR regexp_matches(path, '^www.*[0-9]$') OR len(list_filter(parts, lambda x: regexp_matches(x, '^www.*[0-9]$'))) > 0 THEN true
  ELSE false END AS ignored FROM s""")
def ignore_rules_applied(spark, sf_dir):
    rules = ignore_rules("# comment\n\n*.py\nwww*[0-9]\nen/\n!f.py\n")
    return _paths(spark, sf_dir).select("page_id", ignored(F.col("path"), rules).alias("ignored"))


@query("""SELECT p_partkey, len(list_intersect(string_split(lower(p_type), ' ')[:1], ['build', 'dist', 'out'])) > 0 AS skipped FROM part""")
def ignored_directories(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    path = F.concat(F.element_at(F.split(F.lower("p_type"), " "), 1), F.lit("/build.py"))
    return p.select("p_partkey", in_ignored_dir(path).alias("skipped"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return debounced(_table(spark, sf_dir, "events").select("user_id", "ts"), "30 minutes", ("user_id",))


@query(f"""WITH k AS (SELECT doc_id, rank FROM ({_bm25_sql(_WORDS, limit=15)})), t AS (SELECT doc_id, {_DOC_TOKENS} AS t FROM documents SEMI JOIN k USING (doc_id)),
r AS (SELECT doc_id, round(len(list_intersect(list_distinct(t), ['reading', 'thing', 'clown', 'que'])) / 4.0::DOUBLE, 6) AS score FROM t)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r QUALIFY rank <= 5""")
def rerank_widened(spark, sf_dir):
    wide, _ = fusion.widened(5, True)
    hits = _keyword(spark, sf_dir, _WORDS, limit=wide)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rerank(docs.join(F.broadcast(hits), "doc_id"), _WORDS, document="text", id_col="doc_id", limit=5)
    return found.select("doc_id", F.round("score", 6).alias("score"), "rank")
