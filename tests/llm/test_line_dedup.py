from helpers import DATA, same_rows

from quern.llm.line_dedup import OP2_SQL, dedup_lines, op2_line_dedup


def brute(rows):
    seen, cover = {}, {}
    for doc, text in sorted(rows):
        full = [i for i, x in enumerate(text.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        lines = text.split("\n")
        for j in range(len(full) - 2):
            w = tuple(lines[i] for i in full[j : j + 3])
            if w not in seen:
                seen[w] = (doc, j)
                continue
            d, k = seen[w]
            start = full[max(j, k + 3)] if d == doc else full[j]
            cover.setdefault(doc, set()).update(range(start, full[j + 2] + 1))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cover.get(d, ())) for d, t in rows}


def test_sql(spark):
    same_rows(op2_line_dedup(spark, str(DATA)), OP2_SQL)


def test_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randrange(12)))) for i in range(60)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(rows)
    assert all(r["n_removed"] == (r["n_lines"] - r["text"].count("\n") - 1 if r["text"] or r["n_removed"] < r["n_lines"] else r["n_lines"]) for r in got)


def test_odd_documents(spark, odd, nothing):
    got = dedup_lines(odd).collect()
    assert len(got) == odd.count() and set(odd.columns) <= set(got[0].asDict())
    by = {r["doc_id"]: r for r in got}
    assert by[11]["text"] == "a\nb\nc\nd" and by[12]["text"] == "" and by[12]["n_removed"] == 4
    assert by[13]["text"] == "x\nx\nx" and by[3]["text"] is None and by[3]["n_lines"] == 0 and by[2]["n_lines"] == 1
    assert dedup_lines(nothing).count() == 0


def test_passages_of_one_and_two_lines(spark):
    """With `passage`, as in the query, a repeat of one or two long lines goes, in short texts too; short lines stay."""
    long, a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 50), ("a", 30), ("b", 25)))
    rows = [(1, f"x\n{long}\ny"), (2, f"p\n{long}\nq"), (3, long), (4, f"{a}\n{b}"), (5, f"k\n{a}\n \n{b}\nl"), (6, f"{a}\nother"), (7, f"{long}\n{long}\nnew"), (8, "x\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(docs, passage=50).collect()}
    want = dict(rows) | {2: "p\nq", 3: "", 5: "k\nl", 7: "new"}
    assert {i: t for i, (t, _) in got.items()} == want
    assert {i: n for i, (_, n) in got.items() if n} == {2: 1, 3: 1, 5: 3, 7: 2}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == dict(rows)
