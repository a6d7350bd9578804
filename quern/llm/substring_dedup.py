"""Removal of word sequences that other documents hold, by compressed indexes over shards.

A window is WIDTH consecutive words. Its anchor is the least hash of its shingles of GRAM words, so that equal
windows have equal anchors; consecutive windows with one anchor are a segment. Anchors are counted over the corpus.
A filter of fixed size holds those that come more than once; segments that it holds (all that can be repeated, and
few others) go to the shard that their anchor names. Texts are taken in blocks; equal segments of a block travel
once, with the least id of their documents, so that a passage of very many documents comes once from each block.
Windows with a very frequent anchor are segments of their own, under the hash of all their words, so that what
surrounds a frequent passage spreads over all shards.

A shard indexes the segments whose anchors come more than once (a full-text index over a wavelet matrix), streams
them through it by backward search, and reports, as intervals of each block's segments, the windows whose match
reaches WIDTH in a document with a smaller id. Blocks then meet their reports.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, _powers, drop, mix64, pieces, small_batches, store, table
from quern.llm.fm_index import DEPTH, Index

WIDTH, GRAM = 13, 5
#: Characters of a block and of a chunk of it, segments of a shard, symbols that are indexed at once, windows of a segment.
BLOCK, CHUNK, SHARD, INDEXED, LONGEST = 4 << 20, 1 << 18, 1 << 17, 1 << 21, 64
#: The most anchors that count as frequent, and the bits of the filter: 16 for each anchor, but no more than these (16 MB).
#: A filter that is too small for its anchors lets more segments through, which changes no result.
FREQUENT, BITS = 1 << 14, 27
#: Words are told apart by so many bytes of their hashes.
BYTES = 6
#: A null id comes after all others.
LAST = 2**63 - 1
_RNG = np.random.default_rng(1313)
_PLACE = _RNG.integers(0, 2**63, max(GRAM, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = max(len(h) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width if n else 0):
        out += h[j : n + j] * _PLACE[j]
    return mix64(out)


@dataclass(frozen=True)
class Shared:
    """What is known of the anchors of the corpus: a filter of those that come more than once, and the frequent ones, sorted."""

    bits: np.ndarray
    frequent: np.ndarray

    def has(self, anchor: np.ndarray) -> np.ndarray:
        found = np.ones(len(anchor), bool)
        for at in places(anchor, int(len(self.bits) * 8).bit_length() - 1):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def places(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """The two bits of an anchor in a filter of 2 ** width bits."""
    return [(x >> np.uint64(64 - width)).astype(np.int64) for x in (anchor * np.uint64(0x9E3779B97F4A7C15), mix64(anchor))]


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """The anchor of the window at each word (for as many as there are windows, those over a text's end too)."""
    n, have = max(len(h) - width + 1, 0), 1
    if not n:
        return np.zeros(0, np.uint64)
    whole = _rolled(h, GRAM)
    while have < width - GRAM + 1:  # minima of runs, by doubling
        step = min(have, width - GRAM + 1 - have)
        whole = np.minimum(whole[: len(whole) - step], whole[step:])
        have += step
    return whole


class Segments:
    """The segments of a list of texts, of those known as shared if told: `doc` (its place), `start` (word in the text), `windows`, `anchor`, and `at` (word in all)."""

    def __init__(self, texts: list[str | None], width: int, shared: Shared | None = None):
        w = Words(texts, lower=False)
        self.hash, self.count = w.hash, w.count
        a = anchors(w.hash, width)
        keep = None
        if shared is not None and len(a):
            keep = shared.has(a)
            if len(shared.frequent):
                often = shared.frequent[np.minimum(np.searchsorted(shared.frequent, a), len(shared.frequent) - 1)] == a
                a = np.where(often, mix64(a ^ _rolled(w.hash, width)), a) if often.any() else a
        windows = np.maximum(w.count - width + 1, 0)
        doc = np.repeat(np.arange(len(texts)), windows)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(w.first[:-1], windows) + inner
        if keep is not None:
            some = keep[at]
            doc, inner, at = doc[some], inner[some], at[some]
        a = a[at]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | (inner[1:] != inner[:-1] + 1)
        begin = np.flatnonzero(new)
        run = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(run % LONGEST == 0)
        self.windows = np.diff(np.append(begin, len(at)))
        self.doc, self.start, self.at, self.anchor = doc[begin], inner[begin], at[begin], a[begin]

    def content(self, width: int) -> np.ndarray:
        """A hash of each segment's words."""
        return contents(self.hash, self.at, self.windows + width - 1)


def contents(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of runs of n values."""
    up, down = _powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix64((total[at + n] - total[at]) * down[at] + n.astype(np.uint64))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _counted(width: int, block_size: int):
    """Texts -> their anchors, each with the number of its segments in a run of texts."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in pieces(texts, block_size):
                anchor, n = np.unique(Segments(texts[i:j], width).anchor, return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor.view(np.int64)), "n": pa.array(n)})

    return run


def shared_anchors(texts: DataFrame, width: int) -> tuple[Shared, int]:
    """What is known of the anchors of a table of texts, and how many segments have an anchor that comes more than once."""
    seen = texts.mapInArrow(_counted(width, BLOCK), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    seen = store(seen, "anchors")
    many, total = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(BITS, max(10, math.ceil(math.log2(max(1, many) * 16))))
    frequent = seen.where(F.col("n") * FREQUENT >= total).select("anchor").collect()  # at most FREQUENT
    part = 20  # bits of a place within its part of the filter

    def lit(batches):
        for b in batches:
            anchor = np.asarray(b.column("anchor")).view(np.uint64)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.unique(np.concatenate(places(anchor, bits))))})

    def packed(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.asarray(b.column("at"))
            for p in np.unique(at >> part).tolist():
                held.setdefault(p, np.zeros(1 << part, bool))[at[at >> part == p] & ((1 << part) - 1)] = True
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int64()), "bits": pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())})

    rows = seen.select("anchor").mapInArrow(lit, "at long").repartition(max(1, 1 << max(0, bits - part)), F.shiftright("at", part)).mapInArrow(packed, "part long, bits binary")
    whole = np.zeros(max(1 << bits, 1 << part) // 8, np.uint8)
    for r in rows.collect():  # 2 ** BITS bits at most
        whole[(r["part"] << part) // 8 :][: (1 << part) // 8] |= np.frombuffer(r["bits"], np.uint8)
    drop(seen)
    return Shared(whole[: (1 << bits) // 8], np.sort(np.array([r["anchor"] for r in frequent], np.int64).view(np.uint64))), total


_CHUNKS = "block long, chunk int, ids binary, sizes binary, texts binary, segments binary, start binary, windows binary, content binary, anchor binary"
_SEGMENTS = "shard int, block long, content binary, windows binary, ids binary, tags binary, words binary"
_REPORTS = "block long, content binary, a binary, b binary, other binary"


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = [c.split() for c in kind.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, schema, strict=True)], [c for c, _ in schema])


def _zip(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _texts(sizes: np.ndarray, data: bytes) -> list[str | None]:
    """The texts of a chunk, from their sizes in bytes (-1: null)."""
    n = np.maximum(sizes, 0)
    raw = pa.decompress(data, int(n.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(n).tolist()
    return [None if s < 0 else raw[e - s : e].decode("utf-8", "surrogatepass") for s, e in zip(sizes.tolist(), ends, strict=True)]


def _chunks(width: int, shared: Shared, block_size: int, chunk_size: int):
    """Texts -> chunks of blocks, with the segments that can be shared."""

    def chunk(block: int, number: int, ids: list[int], texts: list[str | None]):
        s = Segments(texts, width, shared)
        raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([-1 if r is None else len(r) for r in raw], "<i4")
        return _batch(_CHUNKS, [(
            block, number, np.array(ids, "<i8").tobytes(), sizes.tobytes(), _zip(b"".join(r or b"" for r in raw)), np.bincount(s.doc, minlength=len(ids)).astype("<i4").tobytes(), s.start.astype("<i4").tobytes(),
            s.windows.astype("<u1").tobytes(), s.content(width).astype("<u8").tobytes(), s.anchor.astype("<u8").tobytes(),
        )])

    def run(batches):
        from pyspark import TaskContext

        block, number, whole, size = TaskContext.get().partitionId() << 32, 0, 0, 0
        ids: list[int] = []
        texts: list[str | None] = []
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = len(t) if t is not None else 0
                if texts and size + n > chunk_size:
                    yield chunk(block, number, ids, texts)
                    number, whole = number + 1, whole + size
                    ids, texts, size = [], [], 0
                    if whole + n > block_size:
                        block, number, whole = block + 1, 0, 0
                ids.append(i)
                texts.append(t)
                size += n
        if texts:
            yield chunk(block, number, ids, texts)

    return run


def _get(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _dealt(width: int, shards: int):
    """Chunks -> the distinct segments of each block (of what a task has of it) for each shard."""

    def deal(rows: list[dict]):
        ids, sizes, content, anchor = (_get(rows, c, k) for c, k in (("ids", "<i8"), ("sizes", "<i4"), ("content", "<u8"), ("anchor", "<u8")))
        start, windows = _get(rows, "start", "<i4").astype(np.int64), _get(rows, "windows", "<u1").astype(np.int64)
        if not len(content):
            return
        doc = np.repeat(np.arange(len(ids)), _get(rows, "segments", "<i4"))
        w = Words([t for r in rows for t in _texts(np.frombuffer(r["sizes"], "<i4"), r["texts"])], lower=False)
        assert len(w.count) == len(sizes)
        _, first, number = np.unique(content, return_index=True, return_inverse=True)
        least = np.full(len(first), LAST)
        np.minimum.at(least, number, ids[doc])
        shard = (anchor[first] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((first, shard))
        shard, at, least = shard[order], first[order], least[order]
        n = windows[at] + width - 1
        words = w.hash[_ranges(w.first[doc[at]] + start[at], n)].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]
        each, ends = np.searchsorted(shard, np.arange(shards + 1)), np.concatenate([[0], np.cumsum(n)])
        out = []
        for k in np.flatnonzero(np.diff(each)).tolist():
            i, j = each[k], each[k + 1]
            own = at[i:j]
            out.append((k, rows[0]["block"], content[own].tobytes(), windows[own].astype("<u1").tobytes(), least[i:j].astype("<i8").tobytes(), (anchor[own] >> np.uint64(32)).astype("<u4").tobytes(), words[ends[i] : ends[j]].tobytes()))
        yield _batch(_SEGMENTS, out)

    def run(batches):
        rows: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if rows and rows[0]["block"] != r["block"]:
                    yield from deal(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from deal(rows)

    return run


def reports(block: np.ndarray, content: np.ndarray, doc: np.ndarray, windows: np.ndarray, symbols: np.ndarray, width: int):
    """Segments of one or more blocks -> (block, content, from, to, id): runs of windows that start in `id` too, which is less than the segment's own.

    Equal segments are indexed once, under their least id.
    """
    n = windows + width - 1
    begin = np.cumsum(n) - n
    dense = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    _, first, kind = np.unique(contents(symbols, begin, n), return_index=True, return_inverse=True)
    least = np.full(len(first), LAST)
    np.minimum.at(least, kind, doc)
    m = n[first]
    text = np.zeros(int((m + 1).sum()), np.int64)
    own = np.cumsum(m + 1) - m - 1
    text[_ranges(own, m)] = dense[_ranges(begin[first], m)]
    index = Index(text, int(dense.max()) + 1)
    ends = _ranges(own + width - 1, windows[first])
    length, low, high = index.matches(text, ends, width)
    # what is held by one segment only starts in that segment's documents
    found = np.repeat(least, windows[first])
    some = np.flatnonzero((length == width) & (high - low > 1))
    if len(some):
        of_suffix = np.append(np.repeat(least, m + 1)[index.order], LAST)
        low_, one, back = np.unique(low[some], return_index=True, return_inverse=True)  # matches of one length: equal intervals or apart
        found[some] = np.minimum.reduceat(of_suffix, np.column_stack([low_, high[some][one]]).ravel())[::2][back]
    at = np.cumsum(windows[first]) - windows[first]
    segment = np.repeat(np.arange(len(block)), windows)
    inner = _ranges(np.zeros(len(block), np.int64), windows)
    other = found[_ranges(at[kind], windows)]
    hit = np.flatnonzero(other < doc[segment])
    segment, inner, other = segment[hit], inner[hit], other[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (inner[1:] != inner[:-1] + 1) | (other[1:] != other[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(hit)) - 1
    return block[segment[a]], content[segment[a]], inner[a], inner[b], other[a]


def _shard(rows: list[dict], width: int, indexed: int):
    """All rows of a shard -> its reports, a row for each block of each part that is indexed at once."""
    content, doc, tag = _get(rows, "content", "<u8"), _get(rows, "ids", "<i8"), _get(rows, "tags", "<u4")
    windows = _get(rows, "windows", "<u1").astype(np.int64)
    words = _get(rows, "words", "<u1").reshape(-1, BYTES)
    block = np.repeat(np.array([r["block"] for r in rows], np.int64), [len(r["windows"]) for r in rows])
    n = windows + width - 1
    begin = np.cumsum(n) - n
    order = np.argsort(tag, kind="stable")
    sorted_tag = tag[order]
    edge = np.flatnonzero(np.append(True, sorted_tag[1:] != sorted_tag[:-1]))
    many = np.diff(np.append(edge, len(order)))
    size = np.add.reduceat(n[order], edge)
    edge, many, size = edge[many > 1], many[many > 1], size[many > 1]
    at = 0
    while at < len(edge):
        to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), indexed, side="right")) + at)
        use = order[_ranges(edge[at:to], many[at:to])]
        held = words[_ranges(begin[use], n[use])]
        symbols = np.zeros((len(held), 8), np.uint8)
        symbols[:, :BYTES] = held
        out = reports(block[use], content[use], doc[use], windows[use], symbols.view("<u8").ravel(), width)
        by = np.argsort(out[0], kind="stable")
        out = [x[by] for x in out]
        ends = np.append(np.flatnonzero(np.append(True, out[0][1:] != out[0][:-1])) if len(by) else [], len(by)).astype(np.int64)
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            yield int(out[0][i]), out[1][i:j].astype("<u8").tobytes(), out[2][i:j].astype("<u1").tobytes(), out[3][i:j].astype("<u1").tobytes(), out[4][i:j].astype("<i8").tobytes()
        at = to


def _search(width: int, indexed: int):
    """Rows sorted by shard -> reports of one shard after the other."""

    def run(batches):
        rows: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if rows and rows[0]["shard"] != r["shard"]:
                    yield _batch(_REPORTS, list(_shard(rows, width, indexed)))
                    rows = []
                rows.append(r)
        if rows:
            yield _batch(_REPORTS, list(_shard(rows, width, indexed)))

    return run


_KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"


def _keep(width: int):
    """A block's texts and reports -> what is kept of each text."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows, found = docs.sort_by("chunk").to_pylist(), found.to_pylist()
        own, sizes, content = _get(rows, "ids", "<i8"), _get(rows, "sizes", "<i4"), _get(rows, "content", "<u8")
        start, windows = _get(rows, "start", "<i4").astype(np.int64), _get(rows, "windows", "<u1").astype(np.int64)
        doc = np.repeat(np.arange(len(own)), _get(rows, "segments", "<i4"))
        words = [(t or "").encode("utf-8", "surrogatepass").split() for r in rows for t in _texts(np.frombuffer(r["sizes"], "<i4"), r["texts"])]
        assert len(words) == len(sizes)
        count = np.array(list(map(len, words)))
        # copies within the block, and what the shards report
        _, number = np.unique(content, return_inverse=True)
        least = np.full(len(content), LAST)
        np.minimum.at(least, number, own[doc])
        told, a, b, other = _get(found, "content", "<u8"), _get(found, "a", "<u1").astype(np.int64), _get(found, "b", "<u1").astype(np.int64), _get(found, "other", "<i8")
        order = np.argsort(told, kind="stable")
        told, a, b, other = told[order], a[order], b[order], other[order]
        from_, to = np.searchsorted(told, content), np.searchsorted(told, content, side="right")
        occurrence = np.repeat(np.arange(len(content)), to - from_)
        of = _ranges(from_, to - from_)
        ok = other[of] < own[doc[occurrence]]
        occurrence, of = occurrence[ok], of[ok]
        copies = np.flatnonzero(least[number] < own[doc])
        base = np.concatenate([[0], np.cumsum(count + 1)])
        spot = base[doc] + start
        mark = np.zeros(base[-1] + 1, np.int64)
        np.add.at(mark, np.concatenate([spot[occurrence] + a[of], spot[copies]]), 1)
        np.add.at(mark, np.concatenate([spot[occurrence] + b[of], spot[copies] + windows[copies] - 1]) + width, -1)
        gone = np.cumsum(mark) > 0
        removed, spans, kept = [], [], []
        for i, w in enumerate(words):
            g = gone[base[i] : base[i] + len(w)]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
            removed.append(int(g.sum()))
            spans.append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
            kept.append(b" ".join(w if not len(edge) else [x for x, y in zip(w, g.tolist(), strict=True) if not y]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": pa.array(own), "n_words": pa.array(count.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: its id, n_words, n_removed, spans (of words, that go) and kept (the other words, joined by a space).

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged on the
    input. Rows of one id are not smaller than one another; null ids come after all others (as 2**63 - 1 would).
    Null and empty texts, and those of fewer words than a window has, lose nothing. An empty table gives an empty
    table; other columns are not read. Windows of GRAM to 16 words are possible. Words are told apart by 48 bits of
    their hashes, segments of one block or shard by 64.
    """
    if not GRAM <= width <= DEPTH:
        raise ValueError(f"width is from {GRAM} to {DEPTH}")
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text_col).alias("text"))
    shared, total = shared_anchors(slim.select("text"), width)
    shards = max(1, math.ceil(total / SHARD))
    chunks = store(slim.mapInArrow(_chunks(width, shared, BLOCK, CHUNK), _CHUNKS), "chunks")
    segments = chunks.mapInArrow(_dealt(width, shards), _SEGMENTS)
    found = segments.repartition(min(shards, 10_000), "shard").sortWithinPartitions("shard", "block").mapInArrow(_search(width, INDEXED), _REPORTS)
    out = chunks.drop("anchor").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_keep(width), _KEPT)
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias(id_col), "n_words", "n_removed", "spans", "kept")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(len(ws) - 12)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS win FROM p),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN m ON g.win = m.win AND m.least < g.doc_id),
l AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
e AS (SELECT w.doc_id, ws, unnest(range(len(ws))) AS pos FROM w),
k AS (SELECT e.doc_id, array_to_string(list(ws[e.pos + 1] ORDER BY e.pos) FILTER (WHERE c.pos IS NULL), ' ') AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.pos = e.pos GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""
