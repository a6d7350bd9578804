"""A stored index for cosine top-k: cells around k-means centres, six bits a dimension, and exact scores for what may count.

Rows stand by cell, as the residual of their unit vector in whole numbers from -STEPS to STEPS with the length of what
is lost. A query reads the codes of the cells that it probes (those with rows of the wanted group only) and then the
vectors of the few rows that are left. Cells have a radius and codes an error, so both bound a score: with exact=True
the result is that of a whole scan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import cosine, doubles, l2_normalize
from quern.operators.bm25 import ranked
from quern.operators.vector_search import literal
from quern.schema import SEARCH_LIMIT

#: Rows that centres are fitted on for each cell, the most cells, rows that are asked for to measure recall, and their neighbours.
FIT, CELLS, ASKED, NEAR = 64, 4096, 64, 10
RECALL, WIDER, FEW, PUSHED = 0.97, 10, 4096, 128
#: Parquet row groups, small enough that a cell's rows are in few of them, and bytes of a page of vectors, of which a few are read.
SIZES = {"parquet.block.size": str(8 << 20)}
PAGE = 2048
#: Whole numbers on either side of 0 that a residual is rounded to; the dictionary of a column has six bits for them.
STEPS = 31
#: Deviations by which a score by codes may be off, where no bound is asked for.
OFF = 4


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, dims)


def _coded(dims: int, centres: np.ndarray):
    """Unit vectors -> cell, code, scale, lost (the length of what the code leaves out) and distance from the centre."""
    half = (centres**2).sum(1) / 2

    def run(batches):
        for b in batches:
            u = _matrix(b.column("unit"), dims)
            cell = np.empty(len(u), np.int32)
            for at in range(0, len(u), 1024):
                cell[at : at + 1024] = np.argmax(u[at : at + 1024] @ centres.T - half, axis=1)
            rest = u - centres[cell]
            scale = np.abs(rest).max(1, initial=0) / STEPS
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None])
            lost = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dims), pa.array(code.astype(np.int8).ravel()))
            made = {"cell": pa.array(cell), "code": codes, "scale": pa.array(scale), "lost": pa.array(lost), "distance": pa.array(np.sqrt((rest**2).sum(1)))}
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "group", "embedding")], *made.values()], ["id", "group", "embedding", *made])

    return run


def _nearest(asked: np.ndarray, dims: int, k: int):
    """Each task's k rows most like each of some unit vectors: query, cell, score."""

    def run(batches):
        score, cell = np.full((len(asked), 0), 0.0), np.zeros((len(asked), 0), np.int32)
        for b in batches:
            x = _matrix(b.column("embedding"), dims)
            n = np.sqrt((x * x).sum(1))
            score = np.hstack([score, asked @ (x / np.where(n > 0, n, 1)[:, None]).T])
            cell = np.hstack([cell, np.broadcast_to(np.asarray(b.column("cell")), (len(asked), len(x)))])
            if score.shape[1] > k:
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        query = np.repeat(np.arange(len(asked), dtype=np.int32), score.shape[1])
        yield pa.RecordBatch.from_pydict({"query": pa.array(query), "cell": pa.array(cell.ravel().astype(np.int32)), "score": pa.array(score.ravel())})

    return run


class VectorIndex:
    """An index in a folder. Every row is in it: those without a vector of the index's width have a place of their own, cell -1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.codes, self.vectors, self.groups = read("codes"), read("vectors"), read("groups")
        about = read("about").first()
        self.dims, self.probes, self.rows, self.recall = about["dims"], about["probes"], about["rows"], about["recall"]
        held = read("cells").orderBy("cell").collect()  # at most CELLS
        self.centres = np.array([r["centre"] for r in held], float).reshape(len(held), self.dims)
        self.radius = np.array([r["radius"] for r in held], float)

    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", group_col: str | None = None, cells: int | None = None, recall: float = RECALL, seed: int = 7) -> VectorIndex:
        """Stores an index of all rows. Centres are fitted on at most FIT rows a cell, drawn by hash; all rows get a cell.

        The number of cells that a query probes is the least with which ASKED rows, drawn by hash, find the share
        `recall` of their NEAR nearest ones. The width is that of most vectors.
        """
        spark = rows.sparkSession
        group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
        slim = rows.select(F.col(id_col).alias("id"), group.alias("group"), F.col(vector_col).alias("embedding"))
        fine = F.forall(doubles(F.col("embedding")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        widths = slim.where(fine).groupBy(F.size("embedding").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), "dims").limit(1).collect()
        dims, n = (widths[0]["dims"], widths[0]["count"]) if widths else (0, 0)
        usable = F.coalesce(fine & (F.size("embedding") == dims), F.lit(False))
        units = slim.where(usable).withColumn("unit", l2_normalize(F.col("embedding")))
        cells = max(1, min(CELLS, cells or math.isqrt(n)))
        drawn = F.pmod(F.xxhash64(F.col("id")), F.lit(max(1, n // (cells * FIT)))) == 0
        if n:
            sample = units.where(drawn).select(array_to_vector("unit").alias("features"))
            model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
            centres = np.array(model.clusterCenters(), float).reshape(-1, dims)
        else:
            centres = np.zeros((0, dims))
        id_kind, vector_kind = slim.schema["id"].dataType.simpleString(), slim.schema["embedding"].dataType.simpleString()
        kind = f"id {id_kind}, group string, embedding {vector_kind}, cell int, code array<tinyint>, scale double, lost double, distance double"
        coded = units.mapInArrow(_coded(dims, centres), kind) if n else spark.createDataFrame([], kind)
        rest = slim.where(~usable).select("*", F.lit(-1).alias("cell"), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "array<tinyint>"), ("scale", "double"), ("lost", "double"), ("distance", "double"))])
        write = lambda df, name, **more: df.write.options(**SIZES, **more).mode("overwrite").parquet(f"{path}/{name}")
        write(coded.unionByName(rest).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "all")
        every = spark.read.parquet(f"{path}/all")
        in_order = lambda df: df.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        write(in_order(every.select("cell", "id", "embedding")), "vectors", **{"parquet.page.row.count.limit": str(max(4, PAGE // (4 * max(dims, 1)))), "parquet.enable.dictionary": "false"})
        write(in_order(every.select("cell", "id", "group", "code", F.col("scale").cast("float").alias("scale"), (F.col("lost") + 1e-6).cast("float").alias("lost"))), "codes")
        write(every.groupBy("group", "cell").agg(F.count("*").alias("n")).coalesce(1), "groups")
        radius = {r["cell"]: r["radius"] for r in every.where("cell >= 0").groupBy("cell").agg(F.max("distance").alias("radius")).collect()}
        listed = [(i, c.tolist(), radius.get(i, 0.0)) for i, c in enumerate(centres)]
        write(spark.createDataFrame(listed, "cell int, centre array<double>, radius double").coalesce(1), "cells")
        probes, found = cls._measure(every, centres, dims, n, recall) if n else (1, 1.0)
        write(spark.createDataFrame([(dims, probes, every.count(), found)], "dims int, probes int, rows long, recall double").coalesce(1), "about")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/all")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return cls(spark, path)

    @staticmethod
    def _measure(every: DataFrame, centres: np.ndarray, dims: int, n: int, recall: float) -> tuple[int, float]:
        """The least number of probed cells with this recall among drawn rows, and the recall with it."""
        coded = every.where("cell >= 0").select("id", "cell", doubles(F.col("embedding")).alias("embedding"))
        drawn = coded.where(F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(max(1, n // (4 * ASKED)))) == 0).orderBy(F.xxhash64("id"), "id").limit(ASKED)
        asked = np.array([r["embedding"] for r in drawn.collect()], float)
        asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        near = coded.select("cell", "embedding").mapInArrow(_nearest(asked, dims, NEAR), "query int, cell int, score double").toPandas()
        near = near.sort_values(["query", "score"], ascending=[True, False]).groupby("query").head(NEAR)
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
        needed = np.sort(place[near["query"], near["cell"]])
        probes = int(needed[max(0, math.ceil(recall * len(needed)) - 1)]) + 1
        return probes, float((needed < probes).mean())

    def _approximate(self, q: np.ndarray, cells: np.ndarray, group: str | None) -> DataFrame:
        """cell, id, score by codes and lost, of the rows of some cells (those of cell -1 have no score)."""
        rows = self.codes.where(F.col("cell").isin([-1, *cells.tolist()]))
        rows = rows.where(F.col("group") == group) if group is not None else rows
        at = F.create_map(*[F.lit(x) for c in cells.tolist() for x in (c, float(self.centres[c] @ q))]) if len(cells) else F.create_map(F.lit(0), F.lit(0.0))
        moved = F.aggregate(F.zip_with("code", literal(q), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return rows.select("cell", "id", (F.try_element_at(at, F.col("cell")) + F.col("scale") * moved).alias("score"), "lost")

    def search(self, vector: Sequence[float], limit: int = SEARCH_LIMIT, group: str | None = None, exact: bool = False, probes: int | None = None, digits: int | None = None) -> DataFrame:
        """id, score (cosine) and rank of the rows most like a vector, of one group if given, best first; ties go to the smaller id.

        exact: no row that a whole scan gives is missed. digits rounds scores before they are compared.
        """
        q = np.asarray(vector, float)
        if len(q) != self.dims:
            return self._scored(self.vectors if group is None else self._of_group(self.vectors, group), vector, limit, digits)
        q = q / max(float(np.linalg.norm(q)), 1e-300)
        there = self.groups if group is None else self.groups.where(F.col("group") == group)
        sizes = {r["cell"]: r["n"] for r in there.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        by = np.argsort(-(self.centres @ q), kind="stable")
        by = by[[c in sizes for c in by.tolist()]]
        at = probes or self.probes
        while at < len(by) and sum(sizes[c] for c in by[:at].tolist()) < WIDER * limit:
            at *= 2
        if exact:
            at = max(1, min(len(by), len(by) // 16))
        first = self._approximate(q, by[:at], group)
        if not exact:
            best = first.where("score is not null").orderBy(F.desc("score"), "id").limit(WIDER * limit).collect()
            if len(best) > limit:
                off = OFF / math.sqrt(max(self.dims, 1))
                best = [r for r in best if r["score"] + off * r["lost"] >= best[limit - 1]["score"] - off * best[limit - 1]["lost"]]
            return self._scored(self._picked(best + self._rest(group, sizes)), vector, limit, digits)
        slack = 0.5 * 10.0**-digits if digits is not None else 0.0  # scores that are equal when rounded may differ by twice that
        low = first.where("score is not null").select((F.col("score") - F.col("lost")).alias("low")).orderBy(F.desc("low")).limit(limit).collect()
        floor = (low[-1]["low"] if len(low) == limit else -np.inf) - 2 * slack - 1e-6
        met = by[(self.centres[by] @ q) + self.radius[by] + 1e-6 >= floor]
        left = self._approximate(q, met, group).where(F.col("score").isNull() | (F.col("score") + F.col("lost") >= F.lit(float(floor)))).select("cell", "id")
        few = left.limit(FEW + 1).collect()
        return self._scored(self._picked(few) if len(few) <= FEW else self.vectors.join(left, ["cell", "id"], "left_semi"), vector, limit, digits)

    def _rest(self, group: str | None, sizes: dict[int, int]) -> list:
        """Rows without a code can only fill up a result that codes leave short."""
        if sum(n for c, n in sizes.items() if c >= 0) or -1 not in sizes:
            return []
        rows = self.codes.where("cell = -1")
        return (rows if group is None else rows.where(F.col("group") == group)).orderBy("id").limit(FEW).select("cell", "id").collect()

    def _of_group(self, rows: DataFrame, group: str) -> DataFrame:
        return rows.join(self.codes.where(F.col("group") == group).select("cell", "id"), ["cell", "id"], "left_semi")

    def _picked(self, rows: list) -> DataFrame:
        """The vectors of a few rows. Their places are pushed to the scan: its pages are in the order of cell and id."""
        if len(rows) > PUSHED:
            return self.vectors.where(F.col("cell").isin(sorted({r["cell"] for r in rows})) & F.col("id").isin([r["id"] for r in rows]))
        each = [(F.col("cell") == r["cell"]) & (F.col("id") == r["id"]) for r in rows] or [F.lit(False)]
        while len(each) > 1:  # a balanced tree, as deep ones are slow to plan
            each = [a | b for a, b in zip(each[::2], each[1::2], strict=False)] + ([each[-1]] if len(each) % 2 else [])
        return self.vectors.where(each[0])

    def _scored(self, rows: DataFrame, vector: Sequence[float], limit: int, digits: int | None) -> DataFrame:
        score = cosine(F.col("embedding"), literal(vector))
        return ranked(rows.select("id", (score if digits is None else F.round(score, digits)).alias("score")), "id", limit)
