"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, store, table, tucked

#: The weights of the sources in code-point order, repeating, and how each weight changes over the
#: training time t from 0 to 1: weight(t) = weight * (1 + slope * (2 t - 1)).
WEIGHTS, SLOPES = (3.0, 1.0, 2.0), (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2
COLUMNS = ("size", "source_size", "target", "taken", "first_take", "second_take", "position", "second_position")


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _inverse(u: Column, slope: Column) -> Column:
    """The time t at which t + slope * (t * t - t), a source's demand up to t, reaches the share u."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
    return F.round(F.when(slope == 0, u).otherwise((root - (1 - slope)) / (2 * slope)), 9)


def _pick(rank: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, slopes=SLOPES, share=SHARE, most=MOST) -> DataFrame:
    """One row per source: source, __source_size, __target, __slope.

    Weighted filling with ceilings in closed form. With sources in order of ceiling / weight, let level k be
    the one at which the first k - 1 are full and the rest share what is left; the true level is the highest
    of these, as each is a lower bound of it.
    """
    by = sizes.groupBy(source).agg(F.sum(size).alias("__source_size"))
    by = by.withColumn("__rank", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())))
    by = by.select(source, "__source_size", _pick(F.col("__rank"), weights).alias("__w"), _pick(F.col("__rank"), slopes).alias("__slope"), "__rank")
    cap = most * F.col("__source_size")
    everything = Window.partitionBy()
    before = Window.orderBy(cap / F.col("__w"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    since = Window.orderBy(cap / F.col("__w"), "__rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = share * F.sum("__source_size").over(everything)
    by = by.withColumn("__level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("__w").over(since))
    level = F.max("__level").over(everything)
    return by.select(source, "__source_size", F.least(F.col("__w") * level, cap.cast("double")).alias("__target"), "__slope")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, weights=WEIGHTS, slopes=SLOPES, share=SHARE, most=MOST) -> DataFrame:
    """Adds to each row what the mix takes of it, and when, and sorts the rows by the time of the first taking.

    Each source's rows stand in an order of hashes of `key` and size (ties: key, then size) and are read up to `most`
    times over until its target is met; the row on the border is taken in part, by its first words. Row order
    needs no group in one task: rows fall into about sqrt(n) hash ranges for each source, only sums of which
    are put in a line. Adds `size`, `source_size`, `target`, `taken` (`first_take` + `second_take`), `position`
    and `second_position` (null where nothing is taken). Null texts have size 0, null sources are one source
    (the last), null keys sort first; equal rows share alike in any order; an empty table gives an empty table.
    Columns of these names in the input are replaced; others are carried along.
    """
    assert most == 2, "positions are kept for two readings"
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS], (size if size is not None else words(F.col("text"))).alias("size"))
    carried = docs.columns[:-1]
    rows = tucked(docs, __key=F.col(key), __source=F.col(source), __size=F.col("size"))
    n = rows.count()
    ranges = max(1, math.isqrt(n))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("/", F.coalesce(F.col("__key").cast("string"), F.lit("")), F.col("__size").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__h", hashed).withColumn("__part", F.shiftright(F.col("__h") * ranges, 32))
    by_part = rows.groupBy("__source", "__part").agg(F.sum("__size").alias("__size"))
    by_part = store(by_part, "mix")
    line = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    by_source = targets(by_part, "__source", "__size", weights, slopes, share, most)
    same = F.col("p.__source").eqNullSafe(F.col("s.__source"))
    parts = by_part.withColumn("__before", F.coalesce(F.sum("__size").over(line), F.lit(0))).drop("__size").alias("p")
    parts = parts.join(F.broadcast(by_source.alias("s")) if by_source.count() <= 10_000 else by_source.alias("s"), same).drop(F.col("s.__source"))
    within = Window.partitionBy("__source", "__part").orderBy("__h", F.col("__key").asc_nulls_first(), "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__size").over(within), F.lit(0))).alias("r")
    at = F.col("r.__source").eqNullSafe(F.col("o.__source")) & (F.col("r.__part") == F.col("o.__part"))
    out = rows.join(parts.alias("o"), at, "left").drop(F.col("o.__source"), F.col("o.__part"))
    goal, begin = F.round("__target").cast("long"), F.col("__before") + F.col("__within")
    take = lambda start: F.least(F.greatest(goal - start, F.lit(0)), F.col("__size"))
    first, second = take(begin), take(begin + F.col("__source_size"))
    when = lambda start, taken: F.when(taken > 0, _inverse(F.least(start / goal, F.lit(1.0)), F.col("__slope")))
    made = {
        "size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "taken": first + second, "first_take": first, "second_take": second,
        "position": when(begin, first), "second_position": when(begin + F.col("__source_size"), second),
    }
    out = out.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], *[made[c].alias(c) for c in COLUMNS])
    return out.orderBy(F.col("position").asc_nulls_last(), key)


def taken_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each reading, in training order; a part taken is cut to its first words, spaces as they were."""
    each = F.array(F.struct(F.col("first_take").alias("n"), F.col("position").alias("t")), F.struct(F.col("second_take").alias("n"), F.col("second_position").alias("t")))
    rows = tucked(mixed, text=F.col(text), size=F.col("size"), take=F.explode(F.filter(each, lambda x: x["n"] > 0)))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("take.n").cast("int")), "")
    made = {text: F.when(F.col("take.n") < F.col("size"), head).otherwise(F.col("text")), "position": F.col("take.t")}
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in mixed.columns if c != "second_position"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = store(table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("words")), "sizes")
    out = mix(slim, size=F.col("words"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position", "second_position")


OP6_SQL = r"""
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
d AS (SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || size), 1, 8))::BIGINT AS h FROM b),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w,
             CASE (r - 1) % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE
                 - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / sum(w) OVER (ORDER BY 2 * source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope, least(w * (SELECT max(level) FROM l), 2.0 * source_size)::DOUBLE AS target FROM l),
o AS (SELECT d.*, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS goal,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, least(greatest(goal - a, 0), size) AS t1, least(greatest(goal - source_size - a, 0), size) AS t2 FROM o),
u AS (SELECT *, least(a::DOUBLE / goal, 1.0) AS u1, least((a + source_size)::DOUBLE / goal, 1.0) AS u2 FROM k)
SELECT doc_id, size, source_size, target, (t1 + t2)::BIGINT AS taken,
       CASE WHEN t1 > 0 THEN round(CASE WHEN slope = 0 THEN u1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u1) - (1 - slope)) / (2 * slope) END, 9) END AS position,
       CASE WHEN t2 > 0 THEN round(CASE WHEN slope = 0 THEN u2 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u2) - (1 - slope)) / (2 * slope) END, 9) END AS second_position
FROM u
"""
