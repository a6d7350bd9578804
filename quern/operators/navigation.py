"""Usages and definitions of symbols."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import matches_definition, matches_symbol, normalized, symbol_suffixes
from quern.schema import DEFINITION_LIMIT, USAGE_CAP, USAGE_LIMIT


def find_usages(calls: DataFrame, symbol: str, limit: int = USAGE_LIMIT, repo: str | None = None) -> DataFrame:
    """Call sites of a symbol by repo, file and place; a blank symbol has none."""
    hit = calls.where(matches_symbol(F.col("callee_norm"), symbol) if symbol.strip() else F.lit(False))
    hit = hit.where(F.col("repo") == repo) if repo else hit
    return hit.orderBy(F.col("repo").asc_nulls_first(), "file", "pos").limit(limit).select("repo", "file", "line", "preview")


def suffix_counts(calls: DataFrame) -> DataFrame:
    """symbol (normalised), n: call sites of every dotted suffix."""
    return calls.select(F.explode(symbol_suffixes(F.col("callee_norm"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def count_usages(calls: DataFrame, symbols: Iterable[str], cap: int = USAGE_CAP) -> DataFrame:
    """symbol (as given), n: capped counts of call sites, 0 where there are none; blank symbols are left out."""
    spark = calls.sparkSession
    wanted = sorted({s for s in symbols if s.strip()})
    names = spark.createDataFrame([(s, normalized(s)) for s in wanted], "symbol string, norm string")
    return count_usages_of(calls, names, cap)


def count_usages_of(calls: DataFrame, names: DataFrame, cap: int = USAGE_CAP) -> DataFrame:
    """The same for a table of symbol and norm: one pass over the calls, counted before they meet the symbols."""
    counted = suffix_counts(calls).withColumnRenamed("symbol", "norm")
    return names.join(counted, "norm", "left").select("symbol", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).alias("n"))


# --- stored calls, sorted by their symbols read from the end ---------------------------------


def from_end(symbol: Column) -> Column:
    """A normalised symbol with its parts from the last to the first: what ends alike begins alike."""
    return F.array_join(F.reverse(F.split(symbol, r"\.")), ".")


def ends_with(rev: Column, symbols: Iterable[str]) -> Column:
    """Whether what `from_end` gave ends with one of some normalised symbols, as ranges that reach the scan."""
    out = F.lit(False)
    for s in sorted(set(symbols)):
        r = ".".join(reversed(s.split(".")))
        out |= (rev == r) | ((rev >= f"{r}.") & (rev < f"{r}/"))  # a slash comes next after a dot
    return out


def in_order(calls: DataFrame) -> DataFrame:
    """Calls as they are stored: with rev, sorted by it, so that a symbol is in few row groups."""
    return calls.withColumn("rev", from_end(F.col("callee_norm"))).repartitionByRange("rev", "repo", "file", "pos").sortWithinPartitions("rev", "repo", "file", "pos")


def symbol_numbers(calls: DataFrame) -> DataFrame:
    """rev, n: the call sites of each whole symbol."""
    return calls.groupBy("callee_norm").agg(F.count("*").alias("n")).select(from_end(F.col("callee_norm")).alias("rev"), "n")


def find_stored_usages(calls: DataFrame, symbol: str, limit: int = USAGE_LIMIT, repo: str | None = None) -> DataFrame:
    """find_usages over calls that have rev: the scan reads the range of the symbol."""
    return find_usages(calls.where(ends_with(F.col("rev"), [normalized(symbol)])), symbol, limit, repo)


def count_stored_usages(numbers: DataFrame, symbols: Iterable[str], cap: int = USAGE_CAP) -> DataFrame:
    """count_usages from the numbers of whole symbols (rows of one rev add up), whose ranges alone are read: no call is."""
    wanted = sorted({s for s in symbols if s.strip()})
    names = numbers.sparkSession.createDataFrame([(s, normalized(s)) for s in wanted], "symbol string, norm string")
    few = numbers.where(ends_with(F.col("rev"), map(normalized, wanted))).groupBy("rev").agg(F.sum("n").alias("n"))
    each = few.select(F.explode(symbol_suffixes(from_end(F.col("rev")))).alias("norm"), "n")
    counted = each.join(F.broadcast(names.select("norm").distinct()), "norm", "left_semi").groupBy("norm").agg(F.sum("n").alias("n"))
    return names.join(counted, "norm", "left").select("symbol", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).alias("n"))


def find_definitions(chunks: DataFrame, symbol: str, limit: int = DEFINITION_LIMIT, repo: str | None = None) -> DataFrame:
    """Chunks (or blocks) that define a symbol, one for each repo, file, first line and name, by repo, file and line.

    The name's last part filters first, so that the scan reads row groups of that name only.
    """
    t = normalized(symbol, arrows=False)
    hit = chunks.where((F.col("name") == t.rpartition(".")[2]) & matches_definition(F.col("name"), F.col("class_chain"), symbol) if t else F.lit(False))
    hit = hit.where(F.col("repo") == repo) if repo else hit
    order = "id" if "id" in chunks.columns else "block_pos"
    once = F.row_number().over(Window.partitionBy("repo", "file", "start_line", "name").orderBy(order))
    hit = hit.withColumn("__n", once).where("__n = 1").drop("__n")
    return hit.orderBy(F.col("repo").asc_nulls_first(), "file", "start_line", order).limit(limit)
