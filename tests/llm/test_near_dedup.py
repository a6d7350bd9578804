import random

import numpy as np
from helpers import DATA, same_rows

from quern.llm import near_dedup as D
from quern.llm.components import components, local_labels


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(D.op10_near_dedup(spark, str(DATA))) == brute(rows)


def test_sql(spark):
    same_rows(D.op10_near_dedup(spark, str(DATA)), D.OP10_SQL)


def test_large_groups(spark, monkeypatch):
    """Groups beyond a leaf and beyond a block, chains of copies, a passage that all share, and exact copies."""
    rng = random.Random(6)
    monkeypatch.setattr(D, "BLOCK_DOCS", 40)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(150, 190):  # each like the one before, the ends unlike each other
        chain = [*chain[4:], *(f"c{i}_{j}" for j in range(4))]
        rows.append((i, " ".join(chain)))
    common = " ".join(f"p{i}" for i in range(12))
    rows += [(i, common + " " + " ".join(f"u{i}_{j}" for j in range(60))) for i in range(190, 290)]
    rows += [(i, "the same few words again and again") for i in range(290, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(D.near_duplicates(docs, leaf=32, depth=3)) == brute(rows)


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:75], a[:74], np.arange(14, 100, dtype=np.uint64)]
    i, j = D.linked(sets, 75)
    want = {(x, y) for x in range(4) for y in range(x + 1, 4) if 100 * len(set(sets[x]) & set(sets[y])) >= 75 * len(set(sets[x]) | set(sets[y]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and (0, 1) in want and (0, 2) not in want


def test_recall_of_the_trees():
    """The share of pairs at the threshold that one tree brings together is the one that the number of trees rests on."""
    rng = np.random.default_rng(4)
    n, met = 3000, 0
    same = rng.random((n, D.TOKENS)) < 0.75
    a = rng.integers(0, 2**32, (n, D.TOKENS), dtype=np.uint32)
    b = np.where(same, a, rng.integers(0, 2**32, (n, D.TOKENS), dtype=np.uint32))
    node = rng.integers(0, 2**63, n, dtype=np.uint64)
    pairs = [(k, node[k], node[k]) for k in range(n)]
    for level in (1, 2, 3):
        found = set()
        k = np.array([p[0] for p in pairs])
        at = np.array([p[1] for p in pairs], np.uint64)
        ra, ca = D._branch(at, a[k], level, 0.75)
        rb, cb = D._branch(at, b[k], level, 0.75)
        assert (ra == rb).all()
        pairs = [(int(k[r]), c, c) for r, c, d in zip(ra, ca, cb, strict=True) if c == d]
        found = {p[0] for p in pairs}
        met = len(found) / n
        assert abs(met - D.reached(level, 0.75)) < 0.04
    assert D.recall_of(D.trees_for(0.9999, 0.75, 3), 0.75, 3) >= 0.9999 > D.recall_of(D.trees_for(0.9999, 0.75, 3) - 1, 0.75, 3)


def test_recall_end_to_end(spark):
    """20,000 documents that share a passage, so that trees branch to their depth, and 300 pairs just above the threshold: at the shipped settings all but a few are found."""
    rng = np.random.default_rng(12)
    common = " ".join(f"c{i}" for i in range(40))
    rows, pairs = [], []
    for i in range(20_000):
        rows.append((i, common + " " + " ".join(map(str, rng.integers(0, 10**9, 60)))))
    for k in range(300):
        own = [f"q{k}_{j}" for j in range(104)]  # 100 shingles; 86 of them are shared by a copy without its last 14 words
        pairs.append((20_000 + 2 * k, 20_001 + 2 * k))
        rows += [(20_000 + 2 * k, " ".join(own)), (20_001 + 2 * k, " ".join([*own[:90], *(f"r{k}_{j}" for j in range(14))]))]
    got = result(D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    assert 100 * 86 >= 75 * 114 > 100 * 85  # 86 of 114 shingles: just above the threshold
    assert sum(got[a][1] == got[b][1] for a, b in pairs) >= 0.99 * len(pairs)
    assert sum(got[i][1] != i for i in range(20_000)) == 0


def test_one_large_cluster_moves_rows_once(spark, monkeypatch):
    """Near copies of one page are connected by pivots: what meets block by block is a small share of them, at any size."""
    monkeypatch.setattr(D, "BLOCK_DOCS", 64)
    seen = []
    plain = D._by_group
    monkeypatch.setattr(D, "_by_group", lambda rows: seen.append(rows.count()) or plain(rows))
    base = [f"b{i}" for i in range(300)]
    for n in (600, 1200):
        seen.clear()
        rows = []
        for i in range(n):
            w = list(base)
            w[i % 300] = f"x{i}"
            rows.append((i, " ".join(w)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert {c for _, c, _ in result(D.near_duplicates(docs, leaf=64, depth=1)).values()} == {0}
        assert sum(seen) < 4 * n


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (5, 5), (400, 401), (401, 400)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 200: 100, 300: 100, 400: 400, 401: 400}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert local_labels(6, np.array([4, 2]), np.array([2, 1])).tolist() == [0, 1, 1, 3, 1, 5]


def test_odd_documents(odd, nothing):
    got = D.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[3]["n_shingles"] == 0 and by[2]["kept"] and by[6]["kept"]
    assert by[9]["n_shingles"] == 1 and by[12]["component_id"] == 11 and by[None]["kept"] and by[None]["component_id"] is None
    assert by[10]["component_id"] == 10 and D.near_duplicates(nothing).count() == 0


def test_rows_without_an_id_stay_apart(spark):
    """Two rows without an id, each near another document, do not link these; nor do two texts of one id."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(None, a + " x"), (None, b + " y"), (5, a), (9, b), (7, "one text of seven"), (7, "quite another text of it"), (8, a + " z"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in D.near_duplicates(docs).collect())
    assert got == [(0, None, True)] * 4 + [(5, None, False), (7, 7, True), (7, 7, True), (8, None, False), (9, None, False)]
    import corpus_pipeline as P

    left = sorted(r["text"] for r in P.near_copies(spark, docs, "").collect())
    assert left == sorted([a + " x", b + " y", "one text of seven", "quite another text of it", "alone"])


def test_few_words_in_a_batch(spark):
    """Tasks whose texts come to 0 to 6 words in all."""
    for n in range(7):
        text = " ".join("abcdef"[:n])
        assert [len(x) for x in D.shingle_sets([text])] == [0 if n == 0 else max(1, n - 4)]
        assert [len(x) for x in D.shingle_sets([" ".join("abcdef"[: n // 2]), None, " ".join("abcdef"[: n - n // 2])])] == [int(n > 1), 0, int(n > 0)]
    three = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in D.near_duplicates(three).collect()] == [(1, 1, True)]


def test_linked_rows_of_one_id(spark):
    """Both are kept, as their id is their component's; one of them is its head."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(7, " ".join(words)), (7, " ".join(words[:-1])), (9, " ".join(words[1:]))], "doc_id long, text string")
    got = sorted(tuple(r) for r in D.near_duplicates(docs).select("doc_id", "component_id", "kept", "head").collect())
    assert [r[:3] for r in got] == [(7, 7, True), (7, 7, True), (9, 7, False)] and sum(r[3] for r in got) == 1
