import zlib

import numpy as np
from helpers import DATA
from pyspark.sql import functions as F

from quern.llm import lang_id as N


def test_held_out_accuracy(spark):
    data = DATA.parent / "sf0.01"
    got = {r["doc_id"]: r for r in N.op7_lang_id(spark, str(data)).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    out = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in out) and np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_every_byte_is_labelled_once():
    texts = [b"ab  cd\n", b"", b"x" * 1000, b" lead", "é è".encode() * 90, b""]
    x, begins = N.letters(texts)
    start, end, read, until, first = N.windows(begins)
    assert (np.sort(np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)])) == np.arange(len(x))).all()
    for i, t in enumerate(texts):
        for w in range(first[i], first[i + 1]):
            assert begins[i] <= read[w] <= start[w] < end[w] <= until[w] <= begins[i + 1]
            assert read[w] in (begins[i], start[w] - N.CONTEXT) and until[w] in (begins[i + 1], end[w] + N.CONTEXT)
    m = N.matrix(x, read, until)
    assert all((m[: b - a, w] == x[a:b]).all() and not m[b - a :, w].any() for w, (a, b) in enumerate(zip(read, until, strict=True)))


def test_evidence_is_the_plain_recurrence():
    """Windows of any batch give what one step at a time in both directions does; states cross words."""
    net = N.Network(3)
    x, begins = N.letters([b"the cat sat", b"on a mat and then went far away" * 12])
    *spans, _ = N.windows(begins)
    got = net.evidence(x, *spans)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(d, run):
        h, out, k = np.zeros(N.HIDDEN), [], N.HIDDEN
        for byte in run:
            a, r = net.p["emb"][byte] @ net.p[f"w{d}"] + net.p[f"c{d}"], h @ net.p[f"u{d}"]
            z, reset = sigmoid(a[:k] + r[:k]), sigmoid(a[k : 2 * k] + r[k : 2 * k])
            new = np.tanh(a[2 * k :] + reset * r[2 * k :])
            h = new + z * (h - new)
            out.append(h)
        return np.array(out)

    for w, (start, end, read, until) in enumerate(zip(*spans, strict=True)):
        run = x[read:until]
        logit = np.concatenate([states("f", run), states("b", run[::-1])[::-1]], 1) @ net.p["out"] + net.p["bout"]
        logp = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        assert np.allclose(logp[start - read : end - read].sum(0), got[w], rtol=1e-3)


def test_gradients():
    net = N.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, begins = N.letters([b"hello wide world of bytes", b"a shorter one", b"bytes"])
    m, y = N.matrix(x, begins[:-1], begins[1:]), np.arange(3)
    size = np.diff(begins)

    def loss():
        z = net.label(m, N._alive(size, len(m)))[0]
        return -(z[:, np.arange(3), y] * (m > 0)).sum() / size.sum()

    g = net.gradients(m, y)
    for k in net.p:
        v, i = net.p[k].reshape(-1), int(np.argmax(np.abs(g[k])))
        keep, step = v[i], 1e-4
        v[i] = keep + step
        up = loss()
        v[i] = keep - step
        down = loss()
        v[i] = keep
        assert abs((up - down) / (2 * step) - g[k].ravel()[i]) < 1e-4 * abs(g[k].ravel()[i]) + 1e-8, k


def test_odd_documents(odd, nothing):
    got = N.identify(odd, F.lit(False)).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 6, 7)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"} and set(odd.columns) <= set(got[0].asDict())
    assert {r["lang_pred"] for r in N.identify(odd, F.lit(True)).collect()} == {"und"}
    assert N.identify(nothing, F.lit(False)).count() == 0


def test_sample_is_of_different_texts_and_of_all_of_each(spark, monkeypatch):
    """Copies take one place of the sample, and the end of a long text may be learned."""
    seen = []
    monkeypatch.setattr(N.Network, "fit", lambda self, texts, y, **k: seen.extend(texts))
    texts = ["hot " * 3] * 400 + [f"rare{i} " for i in range(60)] + ["header " * 600 + "ending " * 600]
    N.fit(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), documents=70)
    assert {w for t in seen for w in t.decode().split()} == {"hot", "header", "ending", *(f"rare{i}" for i in range(60))}


def test_no_language_is_left_out(spark):
    """1,100 languages of two texts each, with room for fewer rows: every one is learned."""
    rows = spark.range(2200).selectExpr("concat('text ', id) as text", "concat('l', id % 1100) as lang")
    names, net = N.fit(rows, documents=5, most_rows=1000)
    assert len(names) == 1100 == len(net.p["bout"])


def test_cut():
    for raw in (b"", b"ab", b"x" * 500, b"one two three " * 40, b" " * 300, b"ab " + b"y" * 300 + b" cd ef"):
        parts = N.cut(raw, 64)
        assert b"".join(parts) == raw and all(0 < len(p) <= 128 for p in parts if raw)
    assert N.cut(b"one two three " * 10, 16)[1][:1] != b" "
