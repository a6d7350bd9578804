import corpus_pipeline as P
from helpers import DATA

from quern.llm.common import _STORED, store
from quern.llm.mixing import mix
from test_near_dedup import brute


def stages(spark, docs, sf_dir):
    for name, stage in P.STAGES:
        out = store(stage(spark, docs, sf_dir), name)
        yield name, docs, out
        docs = out


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, before, after in stages(spark, docs, str(DATA)):
        seen[name] = after
        if name != "packing":
            assert after.columns == docs.columns and after.count() > 0
        if name == "near_dedup":
            want = {i for i, (_, _, kept) in brute([(r["doc_id"], r["text"]) for r in before.collect()]).items() if kept}
            assert {r["doc_id"] for r in after.collect()} == want
    assert seen["language_id"].count() == docs.count()  # all of these have letters, in a known language
    texts = {r["doc_id"]: r["text"] for r in seen["near_dedup"].collect()}
    taken = seen["mixing"].collect()
    assert all(texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in taken)
    words = sum(len(t.encode().split()) for t in texts.values())
    assert abs(sum(len(r["text"].encode().split()) for r in taken) - 1.5 * words) < 50
    tokens = {}
    for r in seen["packing"].collect():
        tokens.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in tokens.values())


def test_rejects(spark):
    docs = spark.createDataFrame([(1, "the of and to in is it that the of", "en", "a", 1), (2, "123 456", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "der die und das ist nicht", "de", "b", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.language(spark, docs, "").collect()} <= {1, 5}


def test_odd_documents(spark, odd, nothing):
    for docs in (odd, nothing, odd.select(*nothing.columns)):
        for _, stage in P.STAGES[:-1]:
            got = stage(spark, docs, "")
            assert got.columns == docs.columns
            got.count()
        P.STAGES[-1][1](spark, docs, "").count()


def test_run(spark):
    before = set(_STORED)
    out = P.run(spark, str(DATA))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "turn"]
    names = {p.rsplit("/", 1)[1].split("-")[0] for p in set(_STORED) - before}
    assert "mixing" in names and not names & {"language_id", "line_dedup", "near_dedup", "links", "counts"}  # earlier stages' tables are gone
    assert out.count() > 0
    import __spark_entry__ as entry

    assert sorted(n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()) == sorted(f"op{i}_{x}" for i, x in enumerate(("lm_scoring", "line_dedup", "topk_search", "quality", "media", "mixing", "lang_id", "packing", "html_text", "near_dedup"), 1))


def test_text_of_no_learned_language_goes(spark):
    """Codes with a few letters and text of another language are rejected; a clean document of two languages stays."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 1000").collect()}
    odd = [
        (10**9, '4734663219866878$$$ token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"### La%%% échmentré.### 126.57.31.34%%%'), (10**9 + 1, "Все люди рождаются свободными и равными в своем достоинстве."),
        (10**9 + 2, by["en"][:500] + "\n" + by["de"][:500]),
    ]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in P.language(spark, docs.select(*more.columns).unionByName(more), "").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {10**9 + 2}


def test_packing_follows_the_order_of_mixing(spark):
    """Rows of sorted files keep their order: sequences of earlier stretches hold earlier readings, and no two rows share a turn."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = store(mix(docs).select(*docs.columns, "position").where("position is not null").repartitionByRange(6, "position").sortWithinPartitions("position"), "mixed")
    numbered = P.turns(mixed).select("position", "__turn").orderBy("__turn").collect()
    assert [r["position"] for r in numbered] == sorted(r["position"] for r in numbered) and len({r["__turn"] for r in numbered}) == len(numbered)
    got = P.packed(spark, mixed.drop("position"), "").collect()
    first = {}
    for r in got:
        first.setdefault(r["sequence_id"], set()).add(r["turn"] >> 36)
    assert all(len(parts) == 1 for parts in first.values())  # a file is a stretch here
    order = [min(first[i]) for i in sorted(first)]
    assert order == sorted(order) and sorted(first) == list(range(len(first)))
    taken = {}
    for r in got:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in taken.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
