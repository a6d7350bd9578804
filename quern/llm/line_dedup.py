"""Line deduplication over overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import drop, store, table, tucked

LINES = 3
#: Words from which one or two repeated lines are a passage as three are.
PASSAGE = 50
_LAST = 2**63 - 1
KIND = "array<struct<j:int,w:bigint,v:bigint,size:int," + "".join(f"at{d}:int," for d in range(LINES)) + "words:int>>"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; adds n_lines and n_removed.

    Lines end at line feeds; lines of white space only belong to no window, so that a window is three
    consecutive other lines. A window met before, in the order of (id, text hash, line), covers its lines
    from the first to the last, blank ones between them included; lines covered by a later occurrence go,
    but not those of a first occurrence that it overlaps with in the same text. What remains is joined by
    line feeds. Texts with fewer than three such lines have no window and stay as they are; null texts stay
    null with n_lines 0. passage: windows of one or two such lines count too, in texts of any number of lines, if
    they have so many words. Windows are told apart by two independent 64-bit hashes. Null ids come last; rows
    equal in id and text count as one and fare alike; an empty table gives an empty table. Columns named n_lines or n_removed are replaced, all others carried along.
    """
    second = F.lit(0x5DEECE66D)  # before a value, it gives another hash of it
    docs = docs.drop("n_lines", "n_removed")
    keyed = tucked(docs, text=F.col(text_col), __k=F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), __x=F.xxhash64(F.col(id_col), F.col(text_col)))
    lines = keyed.select("__k", "__x", F.split("text", "\n", -1).alias("l")).where(F.size("l") >= (1 if passage else LINES))
    flat = lambda x: F.trim(F.regexp_replace(x, r"[\t\r\x0B\f]", " "))
    words = (lambda x: F.size(F.split(flat(x), " +"))) if passage else (lambda x: F.lit(0))
    full = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(second, x).alias("g"), (F.length(flat(x)) > 0).alias("full"), words(x).alias("words"))), lambda x: x["full"])
    lines = lines.select("__k", "__x", full.alias("f")).where(F.size("f") >= (1 if passage else LINES))

    def spots(size: int):
        """The windows of so many lines: the first line's number, a hash and the place of each line (the last one's beyond it)."""
        line = lambda j, d: F.element_at("f", j + d)
        kind = [] if size == LINES else [F.lit(size)]
        made = F.transform(F.sequence(F.lit(1), F.size("f") - size + 1), lambda j: F.struct(
            j.alias("j"), F.xxhash64(*[line(j, d)["h"] for d in range(size)], *kind).alias("w"), F.xxhash64(second, *[line(j, d)["g"] for d in range(size)], *kind).alias("v"), F.lit(size).alias("size"),
            *[line(j, min(d, size - 1))["at"].alias(f"at{d}") for d in range(LINES)],
            sum((line(j, d)["words"] for d in range(size)), F.lit(0)).alias("words"),
        ))
        made = made if size == LINES else F.filter(made, lambda s: s["words"] >= passage)
        return F.when(F.size("f") >= size, made).otherwise(F.array().cast(KIND))

    every = F.concat(*map(spots, range(1, LINES + 1))) if passage else spots(LINES)
    windows = store(lines.select("__k", "__x", F.explode(every).alias("s")).select("__k", "__x", "s.*").drop("words"), "windows")
    first = F.min(F.struct("__k", "__x", "j")).alias("first")
    repeated = store(windows.groupBy("w", "v").agg(first, F.count("*").alias("n")).where("n > 1").select("w", "v", "first"), "repeated")
    later = windows.join(repeated, ["w", "v"]).where(F.struct("__k", "__x", "j") != F.col("first"))
    own = (F.col("__k") == F.col("first.__k")) & (F.col("__x") == F.col("first.__x"))
    since = F.col("j") - F.col("first.j")
    begin = F.col("at0")
    for d in range(LINES - 1, 0, -1):
        begin = F.when(own & (since == F.col("size") - d), F.col(f"at{d}")).otherwise(begin)
    cover = later.select("__k", "__x", begin.alias("a"), F.col(f"at{LINES - 1}").alias("b")).groupBy("__k", "__x", "a").agg(F.max("b").alias("b"))
    here = Window.partitionBy("__k", "__x").orderBy("a")
    reach = F.max("b").over(here.rowsBetween(Window.unboundedPreceding, -1))
    cover = cover.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(here))
    cover = cover.groupBy("__k", "__x", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = cover.groupBy("__k", "__x").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("__gone"))
    gone = store(gone, "gone")
    drop(windows, repeated)

    # merged at every size: what is removed grows with the corpus, and the plan with it
    out = keyed.join(gone.hint("merge"), ["__k", "__x"], "left").withColumn("__lines", F.split("text", "\n", -1))
    n = F.size("__lines")
    kept = F.transform(
        F.sequence(F.lit(0), F.size("__gone")),
        lambda i: F.slice(
            "__lines",
            F.when(i == 0, 0).otherwise(F.get("__gone", i - 1)["b"] + 1) + 1,
            F.when(i == F.size("__gone"), n).otherwise(F.get("__gone", i)["a"]) - F.when(i == 0, 0).otherwise(F.get("__gone", i - 1)["b"] + 1),
        ),
    )
    removed = F.aggregate("__gone", F.lit(0), lambda s, x: s + (x["b"] - x["a"] + 1).cast("int"))
    made = {
        text_col: F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n), "n_removed": F.coalesce(removed, F.lit(0)),
    }
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in [*docs.columns, "n_lines", "n_removed"]])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), passage=PASSAGE)


OP2_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM e WHERE length(trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) > 0),
n AS (SELECT *, len(regexp_extract_all(line, '[^ \t\r\x0B\f]+')) AS words, line || chr(10) || lead(line) OVER p AS two, line || chr(10) || lead(line) OVER p || chr(10) || lead(line, 2) OVER p AS three,
             lead(pos) OVER p AS at1, lead(pos, 2) OVER p AS at2 FROM f WINDOW p AS (PARTITION BY doc_id ORDER BY j)),
m AS (SELECT *, words + lead(words) OVER (PARTITION BY doc_id ORDER BY j) AS pair FROM n),
w AS (SELECT doc_id, j, 3 AS size, pos AS at0, at1, at2, three AS w FROM m WHERE three IS NOT NULL
      UNION ALL SELECT doc_id, j, 2, pos, at1, at1, two FROM m WHERE pair >= 50
      UNION ALL SELECT doc_id, j, 1, pos, pos, pos, line FROM m WHERE words >= 50),
o AS (SELECT *, first_value(doc_id) OVER q AS d1, first_value(j) OVER q AS j1 FROM w WINDOW q AS (PARTITION BY size, w ORDER BY doc_id, j)),
c AS (SELECT doc_id, CASE WHEN doc_id = d1 AND j - j1 = size - 1 AND size > 1 THEN at1 WHEN doc_id = d1 AND j - j1 = 1 AND size = 3 THEN at2 ELSE at0 END AS a, at2 AS b
      FROM o WHERE doc_id <> d1 OR j <> j1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM c),
k AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS text, count(g.pos) AS n_removed
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
