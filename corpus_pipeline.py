"""The corpus pipeline: five operators of quern.llm, each over all that the one before it kept."""

from __future__ import annotations

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, drop, settled
from quern.llm.lang_id import UNKNOWN, identify
from quern.llm.line_dedup import PASSAGE, dedup_lines
from quern.llm.mixing import mix, taken_texts
from quern.llm.near_dedup import near_duplicates, row_key
from quern.llm.packing import pack_documents

#: Documents whose language is less likely than this are rejected.
SURE = 0.4
#: And documents of which the learned languages explain less than this share (see `identify`). Held-out labelled
#: rows of sf0.1 without numbers or codes for most of their bytes are at 0.45 or more.
EXPLAINED = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which the language is known: not those without a letter, nor those below SURE or EXPLAINED."""
    named = identify(docs, crc_mod("doc_id", 4) == 2, carry=docs.columns, explained="__explained")
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE) & (F.col("__explained") >= EXPLAINED)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows and of one or two lines of PASSAGE words; a document of which nothing is left goes."""
    out = dedup_lines(docs, passage=PASSAGE)
    cut = F.col("n_removed") > 0
    out = out.where(~cut | (F.length("text") > 0)).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; rows equal in id and text are one document."""
    kept = near_duplicates(docs, key_col="__key").where("head").select("__key").distinct()
    return docs.withColumn("__key", row_key()).join(kept.hint("merge"), "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents as often and as far as the mix does: a row for each reading, in training order."""
    taken = taken_texts(mix(docs))
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def turns(docs: DataFrame) -> DataFrame:
    """Adds __turn, each row's place in training order. Mixing writes sorted files, so a row's place is its file's
    number and its number within the file; rows that come from no files have the order in which they are read."""
    try:
        at = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.withColumn("__turn", F.monotonically_increasing_id())
    part = F.coalesce(F.regexp_extract("__file", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return at.withColumn("__turn", F.shiftleft(part, 36) + F.col("__row")).drop("__file", "__row")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens, packed and numbered in stretches of training order; `turn`
    is the row's place in that order, which tells two readings of a document apart."""
    out = pack_documents(turns(docs.select("doc_id", "text")), turn="__turn")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.col("__turn").alias("turn"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mixture), ("packing", packed)]

#: A recurrent network, a randomised join and a subword tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again, and dropped as the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
