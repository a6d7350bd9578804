"""Alignment of two tokenizers over the same bytes.

Each token owns a run of bytes: np.repeat of the token numbers over their lengths gives the owner of every byte, for
either tokenizer. Consecutive distinct pairs of owners are the overlaps; bytes after which both owners change are
cuts, which divide the tokens into groups. How many documents link an A id with a B id is counted over the corpus.

Texts are aligned many at a time: the end of a text is a cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import drop, held_id, pieces, real_id, small_batches, store, table

A, B = "byte_bpe_50k", "piece_bpe_32k"
#: Characters that are aligned at once, and pairs of occurrences that a text has at most in company.
TOGETHER, PAIRS = 1 << 19, 1 << 20
#: Pairs with at least this share of all (pair, document) rows are broadcast: there are at most HOT of them.
HOT = 1 << 17


class Tokenizers:
    """Ids and bytes of both tokenizers; texts are without special tokens, whose strings are plain text."""

    def __init__(self, a: str = A, b: str = B):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.slow.encode_special_tokens = True
        try:
            with open(public_tokenizers.path(f"{a}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except OSError:
            self.fast = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{b}.model"))
        of_char = byte_of_char()
        names = [self.slow.id_to_token(i) for i in range(self.slow.get_vocab_size())]
        self.a_bytes = [b"" if n is None else bytes(of_char[c] for c in n) if all(c in of_char for c in n) else n.encode() for n in names]
        own = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(own)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # each id as text, before another of its side and at the end of it
        self.a_names = np.array([f"{i}," for i in range(len(names))] + [f"{i}|" for i in range(len(names))], object)
        self.b_names = np.array([f"{i}," for i in range(len(own))] + [f"{i};" for i in range(len(own))], object)

    def encode_a(self, text: str) -> list[int]:
        """For Latin-1, `tiktoken` gives the same ids in a fraction of the time."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text) if self.fast is not None else self.slow.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of space + text by A and of text by B; None if their bytes are not those of space + text, or if there is no text."""
        out: list[tuple[list[int], list[int]] | None] = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw, a = b" " + text.encode("utf-8", "surrogatepass"), self.encode_a(" " + text) if text else []
            same = text and b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            out.append((a, b) if same else None)
        return out


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [i for i in range(256) if i not in set(shown)]
    return {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(hidden)}


class Groups:
    """The groups of aligned tokens: each token's group, and the overlaps of tokens."""

    def __init__(self, a_size: np.ndarray, b_size: np.ndarray):
        owner_a, owner_b = (np.repeat(np.arange(len(s)), s) for s in (a_size, b_size))
        new_a, new_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        cut = new_a & new_b
        group = np.concatenate([[0], np.cumsum(cut)])
        first = np.concatenate([[0], np.flatnonzero(new_a | new_b) + 1])
        self.overlaps = np.column_stack([owner_a[first], owner_b[first]])
        self.a, self.b = group[np.cumsum(a_size) - 1], group[np.cumsum(b_size) - 1]
        self.n = int(group[-1]) + 1
        self.in_a, self.in_b = np.bincount(self.a, minlength=self.n), np.bincount(self.b, minlength=self.n)

    def texts(self, a: np.ndarray, b: np.ndarray, names: tuple[np.ndarray, np.ndarray], ends: np.ndarray) -> list[str]:
        """The groups written out, for each text that ends after so many A and B tokens: ids by commas, sides by a bar, groups by semicolons."""
        before_b = np.cumsum(self.in_b) - self.in_b
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.append(self.a[1:] != self.a[:-1], True), np.append(self.b[1:] != self.b[:-1], True)
        out[np.arange(len(a)) + before_b[self.a]] = names[0][a + last_a * (len(names[0]) // 2)]
        out[np.arange(len(b)) + np.cumsum(self.in_a)[self.b]] = names[1][b + last_b * (len(names[1]) // 2)]
        flat = out.tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def pairs(self, a: np.ndarray, b: np.ndarray, most: int = PAIRS):
        """The distinct linked id pairs and how often each is linked, in runs of A ids of about `most` pairs before equal ones are merged."""
        kind_a, times_a = np.unique(np.column_stack([a, self.a]), axis=0, return_counts=True)
        kind_b, times_b = np.unique(np.column_stack([self.b, b]), axis=0, return_counts=True)
        begin = np.searchsorted(kind_b[:, 0], np.arange(self.n + 1))
        many = np.diff(begin)[kind_a[:, 1]]  # how many B ids each (A id, group) meets
        before = np.cumsum(many) - many
        at = 0
        while at < len(kind_a):
            to = max(at + 1, int(np.searchsorted(before, before[at] + most, side="right")))
            if to < len(kind_a):  # an A id stays in one run
                whole = int(np.searchsorted(kind_a[:, 0], kind_a[to, 0]))
                to = whole if whole > at else int(np.searchsorted(kind_a[:, 0], kind_a[to, 0], side="right"))
            n = many[at:to]
            of_a = np.repeat(np.arange(at, to), n)
            of_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[kind_a[at:to, 1]], n)
            key, inverse = np.unique((kind_a[of_a, 0] << 32) | kind_b[of_b, 1], return_inverse=True)
            links = np.bincount(inverse, weights=times_a[of_a] * times_b[of_b], minlength=len(key)).astype(np.int64)
            yield key, links
            at = to


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}
_KIND = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<struct<a:int,b:int,n:long>>"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _batch(out: list[tuple], keys: list[np.ndarray], links: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (row, doc_id, figures, hash) and their pairs; a row with no figures only has more pairs."""
    flat, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, links))
    pair = pa.StructArray.from_arrays([pa.array((flat >> 32).astype(np.int32)), pa.array((flat & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])
    ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
    names = [c.split()[0] for c in _KIND.split(", ")[:8]]
    columns = [pa.array(c, pa.string() if name == "groups_sha256" else pa.int64()) for name, c in zip(names, zip(*out, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pair)], [*names, "pairs"])


def _aligned(own: Tokenizers, heads: list[tuple[int, int]], texts: list[str | None]):
    """Batches of _KIND for some texts; the pairs of a text with very many of them take several rows."""
    none = np.zeros(0, np.int64)
    found = own.tokens([t or "" for t in texts])
    empty = [(*h, 0, 0, 0, 0, 0, "") for h, f in zip(heads, found, strict=True) if f is None]
    if empty:
        yield _batch(empty, [none] * len(empty), [none] * len(empty))
    heads, found = [h for h, f in zip(heads, found, strict=True) if f is not None], [f for f in found if f is not None]
    if not found:
        return
    n_a, n_b = np.array([len(a) for a, _ in found]), np.array([len(b) for _, b in found])
    a, b = (np.concatenate([np.array(f[side], np.int64) for f in found]) for side in (0, 1))
    g = Groups(own.a_size[a], own.b_size[b])
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    first = np.append(g.a[end_a - n_a], g.n)  # the first group of each text
    product = g.in_a * g.in_b
    links = np.add.reduceat(product, first[:-1])
    overlaps = np.diff(np.append(np.searchsorted(g.overlaps[:, 0], end_a - n_a), len(g.overlaps)))
    named = g.texts(a, b, (own.a_names, own.b_names), end_a + end_b)
    figures = zip(heads, n_a.tolist(), n_b.tolist(), np.diff(first).tolist(), links.tolist(), overlaps.tolist(), map(_sha, named), strict=True)
    rows = [(*h, *rest) for h, *rest in figures]
    many = links > PAIRS
    for i in np.flatnonzero(many):
        head, (own_a, own_b) = rows[i], (a[end_a[i] - n_a[i] : end_a[i]], b[end_b[i] - n_b[i] : end_b[i]])
        for key, n in Groups(own.a_size[own_a], own.b_size[own_b]).pairs(own_a, own_b):
            yield _batch([head], [key], [n])
            head = (*head[:2], *[None] * 6)
    few = np.flatnonzero(~many)
    if len(few):
        text = np.repeat(np.arange(len(found)), np.diff(first))
        met = np.where(many[text], 0, product)  # pairs of occurrences in each group
        group = np.repeat(np.arange(g.n), met)
        inner = np.arange(len(group)) - np.repeat(np.cumsum(met) - met, met)
        of_a = np.repeat(np.cumsum(g.in_a) - g.in_a, met) + inner // g.in_b[group]
        of_b = np.repeat(np.cumsum(g.in_b) - g.in_b, met) + inner % g.in_b[group]
        wide = len(own.b_bytes)
        every = len(own.a_bytes) * wide
        key, n = np.unique(text[group] * every + a[of_a] * wide + b[of_b], return_counts=True)
        ends = np.searchsorted(key, few[1:] * every)
        pair = key % every
        yield _batch([rows[i] for i in few], np.split((pair // wide) << 32 | pair % wide, ends), np.split(n, ends))


def _align(a: str, b: str):
    def run(batches):
        if (a, b) not in _TOKENIZERS:
            _TOKENIZERS[a, b] = Tokenizers(a, b)
        own = _TOKENIZERS[a, b]
        for batch in batches:
            rows, docs, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            for i, j in pieces(texts, TOGETHER):
                yield from _aligned(own, list(zip(rows[i:j], docs[i:j], strict=True)), texts[i:j])

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    Texts are encoded as space + text by A and as text by B, which adds a space. n_links: pairs of token occurrences
    in one group; n_best: those whose id pair is held by as many documents as any of its A id; count_sum: the sum of
    these numbers of documents over all links. Null and empty texts, and those whose tokens' bytes are not the
    text's, have no tokens: zeros and an empty groups_sha256. Repeated rows are documents of their own; null ids
    are kept; an empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), held_id(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    aligned = store(slim.mapInArrow(_align(a, b), _KIND), "aligned")
    each = aligned.select("row", F.explode("pairs").alias("p")).select("row", "p.*")
    counts = store(each.groupBy("a", "b").agg(F.count("*").alias("c")), "pairs")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    most = counts.groupBy("a").agg(F.max("c").alias("m"))  # at most a row for each id of the vocabulary
    judged = store(counts.join(F.broadcast(most), "a").select("a", "b", "c", (F.col("c") == F.col("m")).alias("best")), "judged")
    drop(counts)
    frequent = F.col("c") * HOT >= total  # at most HOT pairs
    hot, rare = judged.where(frequent), judged.where(~frequent)
    sums = [F.sum(F.col("n") * F.col("c")).alias("s"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("t")]
    known = each.join(F.broadcast(hot), ["a", "b"]).groupBy("row").agg(*sums)
    others = each.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(rare, ["a", "b"]).groupBy("row").agg(*sums)
    by_row = known.unionByName(others).groupBy("row").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    out = aligned.where("n_a is not null").drop("pairs").join(by_row, "row", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select(real_id("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", none("t").alias("n_best"), none("s").alias("count_sum"), "groups_sha256", "n_overlaps")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents", "doc_id", "text"))
