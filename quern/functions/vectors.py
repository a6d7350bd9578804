"""Column expressions over vectors: normalising, cosine, quantising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    v = doubles(v)
    length = norm(v)
    return F.when(length > 0, F.transform(F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n), lambda x: x)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either is a zero vector, null where lengths differ."""
    a, b = doubles(a), doubles(b)
    both = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(both > 0, dot(a, b) / both).otherwise(0.0))


def ranges(df: DataFrame, column: str) -> DataFrame:
    """Each dimension's least and greatest value over all rows: pos, lo, hi (one row per dimension)."""
    each = df.select(F.posexplode(doubles(F.col(column))).alias("pos", "x"))
    return each.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def range_arrays(df: DataFrame, column: str) -> DataFrame:
    """The ranges as one row of two arrays, to be kept with an index and used for its queries."""
    r = ranges(df, column)
    return r.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("ranges"))


def quantize_int8(v: Column, range_: Column) -> Column:
    """Whole numbers from -128 to 127 by each dimension's range; beyond it they are clipped, without any they are 0."""

    def code(x: Column, r: Column) -> Column:
        step = (r["hi"] - r["lo"]) / 255.0
        return F.when(step > 0, F.least(F.greatest(F.floor((x - r["lo"]) / step) - 128, F.lit(-128)), F.lit(127))).otherwise(0).cast("int")

    return F.zip_with(doubles(v), range_, code)


def quantize_ubinary(v: Column) -> Column:
    """Eight dimensions to a whole number from 0 to 255, positive ones as 1, the first as the highest bit."""
    bits = F.transform(doubles(v), lambda x: F.when(x > 0, 1).otherwise(0))
    groups = F.sequence(F.lit(0), F.ceil(F.size(v) / 8).cast("int") - 1)
    byte = lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0), lambda s, i: s * 2 + F.coalesce(F.try_element_at(bits, g * 8 + i), F.lit(0)))
    return F.when(F.size(v) > 0, F.transform(groups, byte)).otherwise(F.array().cast("array<int>"))


def quantize_binary(v: Column) -> Column:
    """The same bits as signed bytes, each 128 lower."""
    return F.transform(quantize_ubinary(v), lambda x: x - 128)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hash_embedding(tokens: Column, dimensions: int) -> Column:
    """Token counts by hash bucket as a unit vector; no tokens give a zero vector."""
    bucket = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    buckets = F.transform(tokens, bucket)
    # sort the buckets and count runs instead of scanning all tokens for each dimension
    counts = F.aggregate(
        buckets, F.array_repeat(F.lit(0.0), dimensions),
        lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)),
    )
    return l2_normalize(counts)
