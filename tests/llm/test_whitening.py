import numpy as np
import pytest
from helpers import DATA

from quern.llm.whitening import KIND, Mean, op11_whitening, precise, principal, whiten


def brute(rows, k=16, scale=64, shift=1_000_000):
    """vec_id -> (n, deviation, whitened by component without sign, explained), by an eigenvalue routine over all rows."""
    fine = [(i, [float(c) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(scale * c)) + shift for c in v]) for i, v in fine]
    fit = np.array(sorted({tuple(v) for _, v in x}), np.int64)
    n, s = len(fit), [sum(map(int, c)) for c in fit.T]
    centred = np.array([[(n * int(a) - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    total = np.trace(centred.T @ centred / n)
    some = e > 1e-11 * e[0]
    out = []
    for i, v in x:
        dev = [n * a - b for a, b in zip(v, s, strict=True)]
        w = np.array([a / n for a in dev]) @ u / np.sqrt(np.where(some, e, 1))
        out += [(i, c + 1, n, sum(a * a for a in dev), abs(w[c]), e[c] / total) for c in np.flatnonzero(some)]
    return out


def agree(got, rows, **kw):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 5))
    have = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    want = sorted(brute(rows, **kw), key=key)
    assert [r[:4] for r in have] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4] for r in have], [r[4] for r in want], atol=1e-8)
    np.testing.assert_allclose([r[5] for r in have], [r[5] for r in want], rtol=1e-8)
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-7 for r in got)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op11_whitening(spark, str(DATA)).collect()
    assert got[0].__fields__ == [c.split()[0] for c in KIND.split(", ")]
    agree(got, rows)


def test_narrow_basis_and_its_growth(spark):
    """Where the spectrum falls fast the narrow basis is enough; where it is flat the basis grows to all dimensions."""
    rng = np.random.default_rng(3)
    steep = rng.standard_normal((400, 40)) * (60.0 * 0.2 ** np.arange(40)) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]
    flat = rng.standard_normal((400, 40)) * 3
    for data, narrow in ((np.round(steep * 1000), True), (np.round(flat * 100), False)):
        x = data.astype(np.int64)
        fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(3)
        mean = Mean(len(x), x.sum(0).tolist())
        e, u, trace, width = principal(fit, 40, mean, k=2, oversample=6)
        want, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
        assert (width == 8) == narrow
        np.testing.assert_allclose(e, want[::-1][:2], rtol=1e-10)
        np.testing.assert_allclose(np.abs(u.T @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8)
        assert abs(trace - want.sum()) < 1e-9 * trace


def test_odd_vectors(spark):
    """Null, partly null, non-finite and repeated vectors, null and repeated ids, dependent and constant dimensions, clashing columns."""
    rng = np.random.default_rng(1)
    rows = [(i, [a, 2 * a, 7.0, float(rng.normal())]) for i, a in enumerate(rng.normal(size=60).tolist())]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (None, [1.0, 2.0, 3.0, 4.0]), (70, None), (71, [1.0, None, 1.0, 1.0]), (72, [1.0, float("nan"), 1.0, 1.0]), (73, [1.0, float("inf"), 1.0, 1.0]), (2, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, x string, n int, whitened double").repartition(5)
    agree(whiten(df).collect(), rows)
    assert whiten(df.where("false")).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whiten(one).collect() == []
    none = spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<double>")
    assert whiten(none).collect() == []


def test_widths_are_apart(spark):
    rng = np.random.default_rng(2)
    a, b = ([(i + at, rng.normal(size=d).tolist()) for i in range(30)] for at, d in ((0, 3), (100, 5)))
    got = whiten(spark.createDataFrame(a + b, "vec_id long, embedding array<double>")).collect()
    agree([r for r in got if r["vec_id"] < 100], a)
    agree([r for r in got if r["vec_id"] >= 100], b)


def test_large_numbers():
    """Deviations are exact up to a long, and null beyond; so are sums."""
    mean = Mean(3_000_000, [3_000_000 * 5 + 1, 7])
    x = np.array([[6, 0], [1000, -1000], [10**6, 0]], np.int64)
    exact = [sum((3_000_000 * int(a) - s) ** 2 for a, s in zip(v, (3_000_000 * 5 + 1, 7), strict=True)) for v in x]
    assert mean.deviation(x) == [d if d < 2**63 else None for d in exact] and mean.deviation(x)[2] is None
    assert not precise(np.array([1.0]), np.array([0.0]), 1)


def test_a_component_beyond_a_long(spark):
    with pytest.raises(Exception, match="beyond a long"):
        whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
