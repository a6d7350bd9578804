import math
import zlib
from collections import Counter

import numpy as np
from helpers import DATA
from pyspark.sql import functions as F

from quern.llm import gru_lm as G
from quern.llm import lm_scoring as L
from quern.llm.common import Words


def small(seed=0, docs=7):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, docs)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, G.INPUTS, first[-1]).astype(np.int32)
    ids[first[1:] - 1] = G.END
    flat = G.initial(np.arange(G.HEAD, 0, -1), np.ones(G.CLASSES))
    return flat + rng.normal(0, 0.1, G.SIZE).astype(np.float32), ids, first


def test_score_is_the_plain_recurrence():
    """Lanes, spans and carried state give what one step at a time over each document does."""
    flat, ids, first = small()
    p = G.views(flat)
    table = p["emb"] @ p["wi"] + p["bi"]
    want = []
    for a, b in zip(first, first[1:], strict=False):
        h, total = np.zeros((1, G.HIDDEN), np.float32), 0.0
        for i in ids[a:b]:
            logit = h @ p["wc"] + p["bc"]
            c = int(G.classes(np.array([i]))[0])
            total += logit[0, c] - np.log(np.exp(logit).sum())
            if i < G.HEAD:
                inner = p["ww"][c] @ h[0] + p["bw"][c]
                total += inner[i % G.CLASS] - np.log(np.exp(inner).sum())
            _, _, h = G.forward(p, table, np.array([[i]]), np.array([[False]]), h, False)
        want.append(total / math.log(10))
    for lanes in (1, 3, 512):
        assert np.allclose(G.score(flat, ids, first, lanes), want, rtol=1e-4)


def test_outputs_are_a_distribution():
    flat, _, _ = small()
    p = G.views(flat)
    h = np.random.default_rng(1).normal(0, 0.5, (1, 1, G.HIDDEN)).astype(np.float32)
    every = np.arange(G.INPUTS)[None]
    logp, _, _ = G.outputs(p, np.repeat(h, G.INPUTS, 1), every, np.ones_like(every, bool), False)
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_gradients():
    flat, ids, first = small(3, 4)
    flat = flat.astype(np.float64)
    p = G.views(flat)
    tokens, doc, alive = G.grid(ids, first, 3)

    def loss():
        total, h = 0.0, np.zeros((tokens.shape[1], G.HIDDEN))
        for x, _, fresh, real in G.spans(tokens, doc, alive):
            before, _, h = G.forward(p, p["emb"] @ p["wi"] + p["bi"], x, fresh, h[: x.shape[1]], False)
            total -= G.outputs(p, before.astype(float), x, real, False)[0].sum()
            return total  # the first span: later ones do not reach back

    x, _, fresh, real = next(G.spans(tokens, doc, alive))
    before, gates, _ = G.forward(p, p["emb"] @ p["wi"] + p["bi"], x, fresh, np.zeros((x.shape[1], G.HIDDEN)), True)
    _, g, dx = G.outputs(p, before.astype(float), x, real, True)
    g |= G.backward(p, x, fresh, before, gates, dx.reshape(before.shape))
    rng = np.random.default_rng(5)
    for name in ("emb", "wi", "bi", "u", "wc", "bc", "ww", "bw"):
        where = np.argsort(-np.abs(g[name]).ravel())[:50]
        for i in rng.choice(where, 3):
            v, step = p[name].reshape(-1), 2e-2
            keep = v[i]
            v[i] = keep + step
            up = loss()
            v[i] = keep - step
            down = loss()
            v[i] = keep
            slope = (up - down) / (2 * step)
            assert abs(slope - g[name].ravel()[i]) < 0.03 * abs(slope) + 0.02, name


def test_lookup():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    key[:40] = np.arange(40, dtype=np.uint64)  # many with the same high bits
    find = L.Lookup(key, np.arange(len(key)))
    at = find.find(np.concatenate([key, key + np.uint64(1)]))
    assert (find.value[at[: len(key)]] == np.arange(len(key))).all() and (find.find(np.array([2**63 + 1], np.uint64)) == -1).all()
    assert (L.Lookup(np.zeros(0, np.uint64), np.zeros(0, int)).find(key) == -1).all()


def brute_base(rows, learn):
    c, n = Counter(), 0
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    for i, w in words.items():
        if learn(i):
            c.update(w)
            n += len(w)
    z = math.log10(n + 0.1 * (len(c) + 1))
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(c[x] + 0.1) - z for x in w)) for i, w in words.items()}


def test_base_scores_and_gain(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_base([(r["doc_id"], r["text"]) for r in docs.collect()], lambda i: zlib.crc32(str(i).encode()) % 10)
    results = []
    for known in (L.KNOWN, 3000):  # with fewer shared counts, more words are joined: all figures stay
        monkeypatch.setattr(L, "KNOWN", known)
        got = L.op1_lm_scoring(spark, str(DATA)).collect()
        assert len(got) == len(want)
        for r in got:
            n, k, train, base = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, train) and abs(r["base_score"] - base) < 1e-6
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        results.append({r["doc_id"]: r["score"] for r in got})
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(abs(results[0][i] - results[1][i]) < 1e-5 * abs(results[0][i]) for i in want)


def test_odd_documents(spark, odd, nothing):
    got = L.score_documents(odd, F.col("doc_id") == 9).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_tokens"] == by[2]["n_tokens"] == 1 and by[4]["score"] == by[5]["score"] and by[9]["n_known"] == 1
    assert L.score_documents(nothing, F.lit(False)).count() == 0
    unseen = L.score_documents(odd.where("doc_id = 9"), F.lit(True)).first()
    assert unseen["train_tokens"] == 0 and unseen["n_known"] == 0 and math.isfinite(unseen["score"])


def test_tail_class_in_the_key():
    w = Words(["running singing x"])
    k = L.keys(w)
    assert (k & np.uint64(31))[0] == (k & np.uint64(31))[1] and (k & np.uint64(31)).max() < G.TAIL


def encoded(rows):
    return rows.select("doc_id", F.unhex(F.lit("000001000000020008080000")).alias("ids"))


def test_every_training_document_is_read(spark):
    """A document of any hash class changes the weights, none is read twice, and equal rows count as often as they come."""
    for shards in (0, 1, 6, 15, 31, 32, 5000):
        assert [c for low, high in L.rounds_for(shards) for c in range(low, high)] == list(range(16))
    assert [len(L.rounds_for(n)) for n in (0, 2, 6, 16, 20, 5000)] == [1, 2, 6, 8, 10, 16]
    docs = encoded(spark.range(64).withColumnRenamed("id", "doc_id"))
    late = docs.where(F.pmod(F.xxhash64("doc_id", "ids", F.lit(0).cast("long")), F.lit(16)) >= 6).limit(1)
    v = L.Vocabulary(np.arange(3, dtype=np.uint64) * 32, np.ones(3), {0: (3, 3, 1)}, 1)
    start = G.initial(v.count, v.by_class)
    assert np.abs(L.train(late, v) - start).max() > 1e-4
    tokens = []
    many = encoded(spark.createDataFrame([(None,)] * 700 + [(1,)] * 30, "doc_id long"))
    for low, high in L.rounds_for(3):
        tokens.append(L.train(many, v, ((low, high),)))
    assert all(np.abs(t - start).max() > 1e-4 for t in tokens)  # copies of one row are spread over the rounds


def test_weights_do_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(6)
    ids = spark.createDataFrame([(i % 90, bytearray(rng.integers(0, 300, rng.integers(1, 60)).astype("<i2").tobytes())) for i in range(200)], "doc_id long, ids binary")
    v = L.Vocabulary(np.arange(300, dtype=np.uint64) * 32, np.arange(300, 0, -1).astype(float), {0: (45150, 300, 1)}, 10)
    one, other = (L.train(x, v, shard_tokens=700) for x in (ids.coalesce(1), ids.repartition(7, "ids")))
    assert (one == other).all()


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 20_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = F.pmod("doc_id", F.lit(9)) == 0
    one, other = ({r["doc_id"]: r["score"] for r in L.score_documents(x, held).collect()} for x in (docs.coalesce(1), docs.repartition(5)))
    assert len(one) == docs.count() and all(abs(one[i] - other[i]) < 1e-5 * abs(one[i]) for i in one)


def test_sections():
    ids, first = L.sections([np.arange(5), np.arange(2), np.arange(4)], 2)
    assert first.tolist() == [0, 2, 4, 5, 7, 9, 11] and ids.tolist() == [0, 1, 2, 3, 4, 0, 1, 0, 1, 2, 3]


def test_scoring_takes_few_steps_through_a_long_document(monkeypatch):
    """A span of scoring is the longer the fewer documents are left, so that one long text doesn't cost a span for every SPAN words."""
    flat, ids, first = small(8, 40)
    long = np.random.default_rng(9).integers(0, G.INPUTS, 20_000).astype(np.int32)
    both, cut = np.concatenate([ids, long]), np.append(first, first[-1] + len(long))
    spans, outputs = [], G.outputs
    monkeypatch.setattr(G, "outputs", lambda p, before, x, *more: spans.append(x.size) or outputs(p, before, x, *more))
    got = G.score(flat, both, cut)
    assert len(spans) < 10 and max(spans) <= 1.5 * G.PACE
    assert np.allclose(got[:-1], G.score(flat, ids, first), rtol=1e-5) and np.isclose(got[-1], G.score(flat, long, np.array([0, 20_000]))[0], rtol=1e-5)


def test_gates_are_laid_out_in_blocks():
    """What a step computes over all lanes stands in one block for each gate, and gradients come back in the layout of the states."""
    flat, ids, first = small(4, 9)
    p = G.views(flat)
    x, _, fresh, real = next(G.spans(*G.grid(ids, first, 5)))
    before, gates, h = G.forward(p, p["emb"] @ p["wi"] + p["bi"], x, fresh, np.zeros((5, G.HIDDEN), np.float32), True)
    assert before.shape == (*x.shape, G.HIDDEN) and h.shape == (5, G.HIDDEN)
    assert [g.shape for g in gates] == [(len(x), w * G.HIDDEN, 5) for w in (2, 1, 1)] and all(g[0, : G.HIDDEN].flags.c_contiguous for g in gates)
    _, _, dx = G.outputs(p, before, x, real, True)
    assert dx.shape == before.shape and dx.strides[1] == dx.itemsize
