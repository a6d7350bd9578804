"""Calls and numbers of symbols that are stored in the order of their last parts."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.operators.navigation import count_stored_usages, count_usages, ends_with, find_stored_usages, find_usages, from_end, in_order, symbol_numbers

TABLE = "/root/testdata/sf0.01/lineitem.parquet"
NAMES = ["run7", "part12.run3", "a.part12.run3", "run", "7", "a.part5.run5", "part1.run1", "nothing.here", "run33"]


def calls(spark):
    """A call for each line item, by symbols of one to three parts; a third of them are of one symbol."""
    k = F.col("l_partkey").cast("string")
    last = F.concat(F.lit("run"), (F.col("l_partkey") % 97).cast("string"))
    name = F.when(F.col("l_orderkey") % 3 == 0, "hot.run7").when(F.col("l_linenumber") == 1, last).otherwise(F.concat(F.lower("l_returnflag"), F.lit(".part"), k, F.lit("."), last))
    rows = spark.read.parquet(TABLE)
    return rows.select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"), name.alias("callee_norm"), F.lit("").alias("preview"), F.col("l_linenumber").cast("int").alias("pos"))


def test_ranges_and_counts(spark, tmp_path):
    every = calls(spark).cache()
    in_order(every).write.option("parquet.block.size", 1 << 16).parquet(str(tmp_path / "calls"))
    symbol_numbers(every).repartitionByRange("rev").sortWithinPartitions("rev").write.parquet(str(tmp_path / "symbols"))
    stored, numbers = (spark.read.parquet(str(tmp_path / n)) for n in ("calls", "symbols"))
    counts = lambda df: sorted(tuple(r) for r in df.collect())
    want = counts(count_usages(every, NAMES, cap=10**9))
    assert counts(count_stored_usages(numbers, NAMES, cap=10**9)) == want and max(n for _, n in want) > 15_000 and ("nothing.here", 0) in want
    assert counts(count_stored_usages(numbers, NAMES)) == counts(count_usages(every, NAMES)) and numbers.count() < every.count() / 2
    for name in NAMES[:5]:
        assert [tuple(r) for r in find_stored_usages(stored, name).collect()] == [tuple(r) for r in find_usages(every, name).collect()]
    # the range of a symbol is in few row groups
    groups = [f.row_group(i) for p in (tmp_path / "calls").glob("*.parquet") for f in [pq.ParquetFile(p).metadata] for i in range(f.num_row_groups)]
    spans = [c.statistics for g in groups for c in [g.column(j) for j in range(g.num_columns)] if c.path_in_schema == "rev"]
    met = [s for s in spans if s.max >= "run33" and s.min < "run33/"]
    assert len(spans) >= 20 and 0 < len(met) <= 3
    plan = stored.where(ends_with(F.col("rev"), ["run33"]))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(rev,run33.)" in plan and "LessThan(rev,run33/)" in plan


def test_parts_of_symbols(spark):
    df = spark.createDataFrame([("a.b.c",), ("c",), ("bc",), ("b.c",), ("b.cc",), ("c/d",), ("",), ("a..c",)], "s string").withColumn("rev", from_end(F.col("s")))
    found = lambda *names: {r["s"] for r in df.where(ends_with(F.col("rev"), names)).collect()}
    assert found("c") == {"a.b.c", "c", "b.c", "a..c"} and found("b.c") == {"a.b.c", "b.c"} and found("a.b.c", "bc") == {"a.b.c", "bc"} and found() == set()
    assert {r["s"]: r["x"] for r in df.select("s", from_end(F.col("rev")).alias("x")).collect()} == {r["s"]: r["s"] for r in df.collect()}
