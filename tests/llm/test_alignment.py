import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
from helpers import DATA

from quern.llm import alignment
from quern.llm.alignment import Groups, Tokenizers, align, byte_of_char, op12_alignment

HARD = [
    None, "", " ", "x", "x ", "  x  y   ", "tab\there\n \nnew  line \r\n", "ünï cödé ßß 漢字かな 😀😀 x́", "<s> </s> <unk> <0x41> <|endoftext|> it's we'll 123 4567 !?", "a ▁ b", "  nb   em line",
    "word" * 60 + " tail", "漢字" * 300, "aaaa" * 100 + " bbb", "x" * 129 + " y", "12,345.67 (a+b)^2 — “quoted”…", "the the the cat", "\x00\x01 \x7f", "ｆｕｌｌ ﬁ ligature",
]


def brute(rows):
    """By the whole texts, the libraries and nested loops."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    to_byte = byte_of_char()
    docs, held = [], defaultdict(set)
    for i, (doc, text) in enumerate(rows):
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        raw = [[bytes(map(to_byte.get, t.id_to_token(x))) for x in a], [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            docs.append((doc, [], [], []))
            continue
        ends = [np.cumsum(list(map(len, r))).tolist() for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[ids[bisect_right(at, lo) : bisect_right(at, hi)] for ids, at in zip((a, b), ends, strict=True)] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        docs.append((doc, a, b, groups))
        for ga, gb in groups:
            for x in set(ga):
                for y in set(gb):
                    held[x, y].add(i)
    best = Counter()
    for (x, _), ds in held.items():
        best[x] = max(best[x], len(ds))
    out = []
    for doc, a, b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(len(held[p]) == best[p[0]] for p in links), sum(len(held[p]) for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def figures(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert figures(op12_alignment(spark, str(DATA))) == brute(rows)


def test_hard_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "the cat"), (None, "the cat sat"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, pairs string, n_a int").repartition(3)
    want = brute(rows)
    assert figures(align(df)) == want
    assert align(df.where("false")).collect() == []
    for hot in (1, 1 << 60):  # all pairs by the join, all by the broadcast
        monkeypatch.setattr(alignment, "HOT", hot)
        assert figures(align(df)) == want


def test_long_products():
    """Pairs come in several runs of A ids, each pair in one of them."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 300), rng.integers(0, 30, 300)
    g = Groups(np.full(300, 2), np.concatenate([[1], np.full(298, 2), [3]]))
    assert g.n == 1 and len(g.overlaps) == 599
    runs = list(g.pairs(a, b, 50))
    assert len(runs) > 5 and sum(n.sum() for _, n in runs) == 90_000
    keys = np.concatenate([k for k, _ in runs])
    assert len(np.unique(keys)) == len(keys)


def test_odd_documents(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert figures(align(odd)) == brute(rows)


def test_random_texts(spark, monkeypatch):
    """Also where every text has too many pairs for company, and few characters go together."""
    rng = np.random.default_rng(7)
    parts = [" ", "  ", "\n", "a", "the", " of", "é", "漢", "'s", "9", "\t ", "\u00a0 ", "\x1c ", "\u0085", "_", "▁"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(1, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute(rows)
    assert figures(align(df)) == want
    own, heads = Tokenizers(), [(i, i) for i, _ in rows]
    held = lambda: sorted((r["row"], p["a"], p["b"], p["n"]) for batch in alignment._aligned(own, heads, [t for _, t in rows]) for r in batch.to_pylist() for p in r["pairs"])
    all_at_once = held()
    monkeypatch.setattr(alignment, "PAIRS", 2)
    assert held() == all_at_once and len(all_at_once) > 300
