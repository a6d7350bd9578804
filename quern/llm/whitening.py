"""Whitening of embeddings by a randomised range finder.

Vectors become whole numbers, so that the list of distinct vectors, its sums and every vector's distance from the
mean are exact. Each power pass multiplies the covariance with an orthonormal basis over all centred rows (a sum of
small matrices, one a task); Rayleigh-Ritz within the basis gives components and their residuals from the same
pass. A basis of k + OVERSAMPLE columns is tried for PASSES passes; if a residual is then still too large for its
gap, the basis grows to all dimensions, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import small_batches, store, table

K, SCALE, SHIFT = 16, 64, 1_000_000
OVERSAMPLE, PASSES, PRECISE = 12, 4, 1e-11
#: Components with less than this share of the largest eigenvalue have no variance but rounding, and are left out.
NOTHING = 1e-11
_ROWS, _TOGETHER = 8192, 16
KIND = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def _blocks(batches, dims: int):
    """Arrow batches with a column x -> arrays of at most _ROWS rows."""
    for b in batches:
        x = _matrix(b.column("x"), dims)
        for at in range(0, len(x), _ROWS):
            yield x[at : at + _ROWS]


def _total(fit: DataFrame, dims: int, part: Callable[[np.ndarray], object]):
    """The sum of part(rows) over all blocks of rows: a sum in each task, then in a few tasks, then here; None without rows.

    What reaches the driver is _TOGETHER values at most, each of a size that depends on the dimensions alone.
    """

    def first(batches):
        from pyspark import TaskContext

        total = None
        for x in _blocks(batches, dims):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([pickle.dumps(total)], pa.binary())})

    def then(batches):
        held = [(p, d) for b in batches for p, d in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True)]
        if held:
            total = sum((pickle.loads(d) for _, d in held[1:]), pickle.loads(held[0][1]))
            yield pa.RecordBatch.from_pydict({"part": pa.array([held[0][0]], pa.int32()), "data": pa.array([pickle.dumps(total)], pa.binary())})

    parts = fit.select("x").mapInArrow(first, "part int, data binary")
    few = parts.repartition(_TOGETHER, "part").sortWithinPartitions("part").mapInArrow(then, "part int, data binary")
    held = [pickle.loads(r["data"]) for r in sorted(few.collect(), key=lambda r: r["part"])]
    return sum(held[1:], held[0]) if held else None


def _sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python's whole numbers."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return (x if most * max(len(x), 1) < 2**62 else x.astype(object)).sum(0).astype(object)


class Mean:
    """The exact mean S / n of whole vectors as a whole part and a rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the difference of whole numbers is exact before the fraction goes off."""
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S) ** 2, exact; None beyond a long."""
        apart = x - self.whole
        most = (int(np.abs(apart).max()) + 1) * self.n if apart.size else 0
        if most * most * max(x.shape[1], 1) < 2**63:
            return ((apart * self.n - self.rest) ** 2).sum(1).tolist()
        about = (((apart.astype(float) * self.n - self.rest)) ** 2).sum(1)
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero(about < 2.0**64):
            exact = sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(apart[i], self.rest, strict=True))
            out[i] = exact if exact < 2**63 else None
        return out


def _orthonormal(m: np.ndarray) -> np.ndarray:
    return np.linalg.qr(m)[0]


def principal(fit: DataFrame, dims: int, mean: Mean, k: int = K, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvalues (falling), unit eigenvectors (columns) and the trace of the covariance of `fit`, and the basis' last width."""
    rng = np.random.default_rng(seed)
    width, turn = min(dims, k + oversample), 0
    q = _orthonormal(rng.standard_normal((dims, width)))
    while True:

        def product(x: np.ndarray, q=q) -> np.ndarray:
            """Columns: the covariance times the basis; then, in a last one, the variances."""
            c = mean.centred(x)
            return np.column_stack([c.T @ (c @ q), (c * c).sum(0)])

        z = _total(fit, dims, product) / mean.n
        z, trace = z[:, :-1], float(z[:, -1].sum())
        ritz = q.T @ z
        e, u = np.linalg.eigh((ritz + ritz.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        turn += 1
        if width == dims or precise(e, np.linalg.norm(z @ u - (q @ u) * e, axis=0), k):
            return e[:k], (q @ u)[:, :k], trace, width
        if turn < passes:
            q = _orthonormal(z)
        else:
            width = dims
            q = _orthonormal(np.column_stack([z, rng.standard_normal((dims, dims - z.shape[1]))]))


def precise(e: np.ndarray, residual: np.ndarray, k: int) -> bool:
    """Whether each of the first k directions is off by PRECISE at most: its residual over the gap to its neighbours."""
    if len(e) <= k or e[0] <= 0:
        return False
    gap = np.minimum(np.append(np.inf, e[:-1] - e[1:])[:k], (e[:-1] - e[1:])[:k])
    return bool((residual[:k] <= PRECISE * gap).all())


def _whole(scale: int, shift: int):
    def whole(x):
        x = x * float(scale)
        return F.when(F.abs(x) < 2.0**61, F.floor(x) + F.lit(shift)).otherwise(F.raise_error(F.lit("a component of a vector is beyond a long")).cast("long"))

    return whole


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x: the vectors that take part, as whole numbers floor(scale * component) + shift."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")).where("e is not null")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(fine).select("vec_id", F.transform("e", _whole(scale, shift)).alias("x"))


def _whiten(dims: int, mean: Mean, e: np.ndarray, u: np.ndarray, trace: float, error: float):
    k = len(e)

    def run(batches):
        for b in batches:
            x, ids = _matrix(b.column("x"), dims), b.column("vec_id")
            for at in range(0, len(x), _ROWS):
                some = x[at : at + _ROWS]
                each = pa.array(np.repeat(np.arange(at, at + len(some)), k))
                of_row = pa.array(np.repeat(np.arange(len(some)), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))), "n": pa.array(np.full(len(some) * k, mean.n)),
                    "deviation": pa.array(mean.deviation(some), pa.int64()).take(of_row), "whitened": pa.array((mean.centred(some) @ u / np.sqrt(e)).ravel()),
                    "explained": pa.array(np.tile(e / trace, len(some))), "identity_error": pa.array(np.full(len(some) * k, error)),
                })

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, shift: int = SHIFT, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """One row for each vector and component up to k: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components come from the distinct whole vectors, each counted once, so copies don't weigh; every row, copies and
    null ids included, gets its values. Vectors that are null or hold a null or non-finite component take no part.
    Vectors of each width are whitened apart. Components without variance (constant or dependent dimensions, a single
    distinct vector) are left out, and so fewer than k may come; vectors of no dimension, and an empty table, give no
    row. A deviation beyond a long is null; a component of 2**61 or more after scaling is an error. Other columns
    are not read. The driver holds matrices of dimensions by dimensions at most.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    fit = store(rows.select("x").distinct(), "fit")
    out = []
    for r in fit.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).where("dims > 0").orderBy("dims").collect():
        dims, own = r["dims"], fit.where(F.size("x") == r["dims"])
        mean = Mean(r["n"], _total(own, dims, _sums).tolist())
        e, u, trace, _ = principal(own, dims, mean, k, oversample, passes)
        some = e > NOTHING * max(e[0], 0)
        e, u = e[some], u[:, some]
        if not len(e):
            continue

        def products(x: np.ndarray, mean=mean, to=u / np.sqrt(e)) -> np.ndarray:
            w = mean.centred(x) @ to
            return w.T @ w

        error = float(np.abs(_total(own, dims, products) / mean.n - np.eye(len(e))).max())
        out.append(rows.where(F.size("x") == dims).mapInArrow(_whiten(dims, mean, e, u, trace, error), KIND))
    made = out[0] if out else spark.createDataFrame([], KIND)
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
