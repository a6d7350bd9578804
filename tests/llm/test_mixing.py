from collections import defaultdict

from helpers import DATA, same_rows
from pyspark.sql import functions as F

from quern.llm import mixing as M


def fill(sizes):
    """Targets by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(names, [3.0, 1.0, 2.0] * len(names), strict=False))
    left, full, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in rest}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            full.add(s)


def test_sql(spark):
    same_rows(M.op6_mixing(spark, str(DATA)), M.OP6_SQL)


def test_targets_and_readings(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), None if i % 11 == 0 else f"s{i * i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["first_take"] + r["second_take"] == r["taken"] and r["size"] == r["doc_id"] % 37
        assert (r["position"] is None) == (r["first_take"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    want = fill(dict(sizes))
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 0.5
    first = [r["position"] for r in got if r["position"] is not None]
    assert first == sorted(first)  # in training order
    # a falling weight puts more of a source early: its median reading comes before the middle
    again = {r["doc_id"]: (r["taken"], r["position"]) for r in M.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: (r["taken"], r["position"]) for r in got}


def test_texts_taken(spark):
    docs = spark.createDataFrame([(1, " a b\tc ", "x"), (2, "d e f g h i", "y"), (3, "j k", "z")], "doc_id long, text string, source string")
    mixed = M.mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in mixed.collect()}
    words = defaultdict(int)
    for r in M.taken_texts(mixed).collect():
        assert {1: " a b\tc ", 2: "d e f g h i", 3: "j k"}[r["doc_id"]].startswith(r["text"])
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {k: v for k, v in taken.items() if v}


def test_odd_documents(odd, nothing):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["text"] is None} == {0}
    assert all(r["taken"] <= 2 * r["size"] for r in got) and M.taken_texts(M.mix(odd)).count() > 0
    assert M.mix(nothing).count() == 0 and M.taken_texts(M.mix(nothing)).count() == 0
    assert M.mix(odd.where("text is null")).select(F.sum("taken")).first()[0] == 0
