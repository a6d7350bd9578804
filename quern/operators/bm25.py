"""BM25 keyword search: over a table in one pass, or over stored postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quern.functions.text import once, tokenize, tokenize_code
from quern.plans.parallel import spread
from quern.schema import K1, KEYWORD_LIMIT, B

#: Postings of a term and a stretch of documents as one row: the low bits of their numbers, which begin at 0 in a block of 32,768, and their counts. A term can have several rows for a block.
STACKED, BITS = "term string, block long, docs array<short>, tfs array<int>", 15


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    """What a term adds for each unit of its idf."""
    average = F.when(avg_len == 0, 1.0).otherwise(avg_len)
    below = tf + k1 * (1 - b + b * dl / average)
    return tf * (k1 + 1) / F.when(below == 0, 1.0).otherwise(below)


def _counts(text: Column, terms: list[str]) -> Column:
    """The number of tokens of a text (dl) and of each term (tf0, tf1, ...)."""
    left = lambda t, term: F.size(t) - F.size(F.array_remove(t, F.lit(term)))
    return once(tokenize_code(text), lambda t: F.struct(F.size(t).alias("dl"), *[left(t, x).alias(f"tf{i}") for i, x in enumerate(terms)]))


def keyword_scan(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "document", limit: int | None = KEYWORD_LIMIT, where: Column | None = None) -> DataFrame:
    """The best documents for a query: the columns of docs (without the text), score and rank.

    One pass turns each text into its length and its counts of the query's terms, so that only those numbers are
    aggregated and sorted, whatever the vocabulary. Terms given twice count twice. `where` limits what may be
    returned; term statistics are always those of all documents. Ties go to the smaller id.
    """
    return ranked(keyword_scores(docs, query, text_col, where), id_col, limit)


def keyword_scores(docs: DataFrame, query: str, text_col: str = "document", where: Column | None = None) -> DataFrame:
    """The documents with a term of a query: the columns of docs (without the text) and score."""
    terms = Counter(tokenize(query))
    base = spread(docs).withColumn("__c", _counts(F.col(text_col), list(terms))).drop(text_col)
    if not terms:
        return base.drop("__c").where("false").withColumn("score", F.lit(0.0))
    stats = base.agg(F.count("*").alias("__n"), F.coalesce(F.avg("__c.dl"), F.lit(0.0)).alias("__avg"), *[F.count_if(F.col(f"__c.tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    found = base.where(where) if where is not None else base
    score = F.lit(0.0)
    for i, (_, times) in enumerate(terms.items()):
        tf = F.col(f"__c.tf{i}")
        score += F.when(tf > 0, times * idf(F.col("__n"), F.col(f"__df{i}")) * weight(tf, F.col("__c.dl"), F.col("__avg"))).otherwise(0.0)
    # One row of statistics. Rows without a term go by their score, not by a filter on the counts, which would be
    # pushed below the projection and tokenise once for each term.
    found = found.crossJoin(F.broadcast(stats)).withColumn("score", score)
    return found.where("score > 0").select(*[c for c in docs.columns if c != text_col], "score")


def ranked(scored: DataFrame, id_col: str, limit: int | None) -> DataFrame:
    """Adds rank (1 is the best: score, then id) to the best `limit` rows, or to all."""
    top = scored if limit is None else scored.orderBy(F.desc("score"), id_col).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


@dataclass
class Scan:
    """Texts (id, document, any columns) without stored postings: a query counts its terms in passes over them."""

    docs: DataFrame


@dataclass
class Index:
    """Stored postings (id, term, tf; with dl, if lengths were met already), lengths (id, dl), document frequencies (term, df) and one row of totals (n, avg_len)."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to STACKED."""
    for batch in batches:
        terms, tfs, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            found = Counter(tokenize(text))
            terms += found
            tfs += found.values()
            sizes.append(len(found))
        if not terms:
            continue
        words, ids = pa.array(terms, pa.string()).dictionary_encode(), np.repeat(batch.column(0).to_numpy(), sizes)
        codes = words.indices.to_numpy()
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        blocks = ids >> BITS
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
        ends = pa.array(np.r_[first, len(codes)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((ids & (1 << BITS) - 1).astype(np.int16), np.array(tfs, np.int32)[order])]
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(codes[first])), pa.array(blocks[first]), *lists], names=["term", "block", "docs", "tfs"])


def unstacked(rows: DataFrame) -> DataFrame:
    """STACKED rows and any columns beside as one row (term, those columns, doc, tf) for each posting."""
    beside = [c for c in rows.columns if c not in ("term", "block", "docs", "tfs")]
    each = rows.select("term", *beside, "block", F.explode(F.arrays_zip("docs", "tfs")).alias("__p"))
    return each.select("term", *beside, (F.shiftleft("block", BITS) + F.col("__p.docs")).alias("doc"), F.col("__p.tfs").cast("long").alias("tf"))


@F.pandas_udf(LongType())
def n_tokens(texts: pd.Series) -> pd.Series:
    return pd.Series([len(tokenize(t)) for t in texts], dtype="int64")


def build(docs: DataFrame, id_col: str = "id", text_col: str = "document", carry: tuple[str, ...] = (), stacked: bool = False) -> Index:
    """carry: columns of docs that lengths have too. stacked: ids are whole numbers of one row each; their postings are counted where they are read, and are STACKED."""
    if stacked:
        texts = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("__t"))
        postings, lengths = texts.select("id", "__t").mapInArrow(_stacked, STACKED), texts.select("id", *carry, n_tokens("__t").alias("dl"))
        return Index(postings, lengths, frequencies(postings), totals(lengths))
    tokens = spread(docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("__t"))).select("id", *carry, tokenize_code(F.col("__t")).alias("t"))
    postings = tokens.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    lengths = tokens.select("id", *carry, F.size("t").cast("long").alias("dl"))
    return Index(postings, lengths, frequencies(postings), totals(lengths))


def frequencies(postings: DataFrame) -> DataFrame:
    many = F.sum(F.size("docs")) if "docs" in postings.columns else F.count("*")
    return postings.groupBy("term").agg(many.alias("df"))


def totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_len"))


def save(index: Index, path: str) -> None:
    """Postings sorted by term and id, so that a query reads the row groups of its terms only, and a common term is no task of its own."""
    index.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    spark = index.postings.sparkSession
    postings, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    frequencies(postings).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")
    totals(lengths).write.mode("overwrite").parquet(f"{path}/totals")


def load(spark, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "frequencies", "totals")])


def query(index: Index | Scan, text: str, limit: int | None = KEYWORD_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """id, score, rank of the best documents; `allowed` (ids) limits what may be returned, not the statistics."""
    if isinstance(index, Scan):
        hit = keyword_scores(index.docs.select("id", "document"), text).withColumn("score", F.round("score", 9)).where("score > 0")
        return ranked(hit if allowed is None else hit.join(allowed.select("id"), "id", "left_semi"), "id", limit)
    spark = index.postings.sparkSession
    terms = Counter(tokenize(text))
    if not terms:
        return index.lengths.select("id").where("false").withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    wanted = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, times int"))  # the terms of a query
    among = F.col("term").isin(list(terms))
    hit = index.postings.where(among).join(wanted, "term").join(F.broadcast(index.frequencies.where(among)), "term")
    if allowed is not None:
        hit = hit.join(allowed.select("id"), "id", "left_semi")
    hit = (hit if "dl" in hit.columns else hit.join(index.lengths, "id")).crossJoin(F.broadcast(index.totals))
    part = F.col("times") * idf(F.col("n"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avg_len"))
    return ranked(hit.groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0"), "id", limit)
