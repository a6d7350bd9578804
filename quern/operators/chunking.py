"""Blocks to chunks: ids, documents, oversized blocks cut into overlapping parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import chunk_id, content_hash, line_slice, render_document, splitlines
from quern.schema import BLOCK_CHARS, OVERLAP


def split_blocks(blocks: DataFrame, most: int = BLOCK_CHARS, overlap: float = OVERLAP) -> DataFrame:
    """A row per part: part (0: not cut), start_line, end_line and code of the part.

    A block of more than `most` characters is cut into windows of lines whose number follows from its mean line,
    at least 10, with a share of `overlap` (at least 2 lines) in common.
    """
    large = F.length("code") > most
    lines = F.when(large, splitlines(F.col("code")))
    shaped = blocks.withColumn("__l", lines).withColumn("__n", F.coalesce(F.size("__l"), F.lit(0)))
    window = F.greatest(F.lit(10), F.floor(most / F.greatest(F.lit(1), F.floor(F.length("code") / F.col("__n"))))).cast("int")
    shaped = shaped.withColumn("__w", F.when(F.col("__n") > 0, window))
    shaped = shaped.withColumn("__s", F.greatest(F.lit(1), F.col("__w") - F.greatest(F.lit(2), F.floor(F.col("__w") * overlap).cast("int"))))
    parts = F.when(F.col("__n") > 0, F.greatest(F.lit(0), F.ceil((F.col("__n") - F.col("__w")) / F.col("__s"))).cast("int"))
    shaped = shaped.withColumn("__p", F.explode(F.when(parts.isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), parts))))
    cut = F.col("__p") >= 0
    first = F.col("__p") * F.col("__s") + 1
    last = F.least(F.col("__n"), first + F.col("__w") - 1)
    # a text of line ends alone has no lines: one part, as it is, on its first line
    bare = large & ~cut
    return shaped.withColumns({
        "part": F.when(cut, F.col("__p") + 1).when(bare, 1).otherwise(0), "code": F.when(cut, line_slice(F.col("__l"), first, last)).otherwise(F.col("code")),
        "end_line": F.when(cut, F.col("start_line") + last - 1).when(bare, F.col("start_line")).otherwise(F.col("end_line")).cast("int"),
        "start_line": F.when(cut, F.col("start_line") + first - 1).otherwise(F.col("start_line")).cast("int"),
    }).drop("__l", "__n", "__w", "__s", "__p")


def chunk_blocks(blocks: DataFrame, most: int = BLOCK_CHARS, overlap: float = OVERLAP, in_order: bool = False) -> DataFrame:
    """Chunks with unique ids: repo::file::Class::name, @partN for parts, #K for the K-th of one id in a file.

    in_order: partitions are ranges of names and ids, sorted by both. Rows of one id stand in one range, where they are numbered,
    so a text moves once.
    """
    parts = split_blocks(blocks, most, overlap)
    base = chunk_id(F.col("repo"), F.col("file"), F.col("class_chain"), F.col("name"))
    base = F.when(F.col("part") > 0, F.concat(base, F.lit("@part"), F.col("part"))).otherwise(base)
    parts, same = parts.withColumn("__id", base), ["repo", "file", "__id"]
    if in_order:
        # the name, but read from the id: rows of one id have one
        parts = parts.withColumn("__name", F.regexp_replace(F.substring_index("__id", "::", -1), "@part[0-9]+$", "")).repartitionByRange("__name", "__id")
        same = ["__name", *same]
    named = parts.withColumn("__k", F.row_number().over(Window.partitionBy(*same).orderBy("block_pos", "part")))
    chunks = named.select(
        F.when(F.col("__k") > 1, F.concat("__id", F.lit("#"), "__k")).otherwise(F.col("__id")).alias("id"),
        render_document(*map(F.col, ("file", "class_chain", "name", "docstring", "code"))).alias("document"),
        "repo", "file", F.col("block_type").alias("type"), "class_chain", "name", "language", "start_line", "end_line", content_hash(F.col("code")).alias("content_hash"), "docstring",
    )
    return chunks.sortWithinPartitions("name", "id") if in_order else chunks


