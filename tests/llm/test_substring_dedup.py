import hashlib
import random
import re

import numpy as np
import pytest
from helpers import DATA, same_rows

from quern.llm import substring_dedup as S
from quern.llm.fm_index import Bits, Index, Wavelet
from quern.llm.substring_dedup import OP13_SQL, dedup_substrings, op13_substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width=13):
    order = lambda d: 2**63 - 1 if d is None else d
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, 2**63), order(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - width + 1) if least[tuple(w[i : i + width])] < order(d) for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str)


def test_sql(spark):
    same_rows(op13_substring_dedup(spark, str(DATA)), OP13_SQL)


def corpus(rng, n, vocabulary=400):
    """Texts of own words with shared passages at any place, copies, and periodic stretches."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(4)):
            w += [word() for _ in range(rng.randrange(30))]
            w += passages[0] if rng.random() < 0.3 else rng.choice(passages)[rng.randrange(5) :]
            if rng.random() < 0.1:
                w += ["x", "y"][: rng.randrange(1, 3)] * rng.randrange(10, 90)
        rows.append((rng.choice([i, i, i, rng.randrange(n), None]), " ".join(w)))
    return rows + [(n + i, rows[rng.randrange(n)][1]) for i in range(20)]


@pytest.mark.parametrize(("shard", "block", "chunk", "indexed", "frequent", "bits"), [(S.SHARD, S.BLOCK, S.CHUNK, S.INDEXED, S.FREQUENT, S.BITS), (30, 2000, 500, 500, 200, 10), (100, 700, 700, 5000, 1 << 40, 27)])
def test_brute_force(spark, monkeypatch, shard, block, chunk, indexed, frequent, bits):
    """Whatever the number of shards and blocks, the frequent anchors, and a filter that is too small."""
    for name, value in (("SHARD", shard), ("BLOCK", block), ("CHUNK", chunk), ("INDEXED", indexed), ("FREQUENT", frequent), ("BITS", bits)):
        monkeypatch.setattr(S, name, value)
    rows = corpus(random.Random(shard), 150)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, kept string, block int").repartition(3)
    assert got(dedup_substrings(df)) == brute(rows)


def test_small_window(spark):
    rows = corpus(random.Random(9), 80, 30)
    assert got(dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), width=6)) == brute(rows, 6)
    with pytest.raises(ValueError, match="width"):
        dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), width=17)


def test_odd_documents(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(dedup_substrings(odd)) == brute(rows)
    assert dedup_substrings(nothing).collect() == []
    ten = [(i, " ".join(f"a{j}" for j in range(i))) for i in range(16)]
    for r in ten:
        assert got(dedup_substrings(spark.createDataFrame([r], "doc_id long, text string"))) == brute([r])


def test_kept_is_hashed(spark):
    r = op13_substring_dedup(spark, str(DATA)).orderBy("doc_id").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where(f"doc_id = {r['doc_id']}").first()["text"]
    assert r["kept_sha256"] == hashlib.sha256(" ".join(words(text)).encode()).hexdigest() and r["n_removed"] == 0


def test_wavelet_and_index():
    """Ranks against counting, and backward search against a scan."""
    rng = np.random.default_rng(5)
    bits = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert (Bits(bits).ones(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    for size in (2, 3, 9, 64):
        s = rng.integers(0, size, 500)
        w = Wavelet(s, size)
        for c in range(size):
            assert (w.rank(np.full(501, c), np.arange(501)) == np.concatenate([[0], np.cumsum(s == c)])).all()
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(13, 40)), 0) for _ in range(40)])
    index = Index(text, 4)
    ends = np.array([i for i in range(12, len(text)) if not (text[i - 12 : i + 1] == 0).any()])
    length, low, high = index.matches(text, ends, 13)
    held = {}
    for i in range(len(text) - 12):
        held.setdefault(tuple(text[i : i + 13]), []).append(i)
    for e, n, a, b in zip(ends, length, low, high, strict=True):
        same = held[tuple(text[e - 12 : e + 1])]
        assert (n == 13 and b - a > 1) == (len(same) > 1)
        if len(same) > 1:
            assert sorted(index.order[a:b]) == same
