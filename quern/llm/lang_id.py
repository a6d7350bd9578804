"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of a text: WINDOW bytes of its own and up to CONTEXT bytes of the text on either
side, so that states cross words and every byte is labelled once, with what stands around it. A document's
probabilities are pooled from those of all its bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import SPACES, crc_mod, drop, pieces, small_batches, store, table

WINDOW, CONTEXT, EMBED, HIDDEN, UNKNOWN = 256, 16, 8, 10, "und"
#: The network is fitted to a bounded sample of labelled documents: at most so many different texts of each
#: language and so many in all (but one of each language), and of each text windows of FIT_WINDOW bytes up to
#: FIT_BYTES, drawn from all of it; scoring reads every byte of every text.
FIT_DOCUMENTS, FIT_ROWS, FIT_WINDOW, FIT_BYTES, EPOCHS, BATCH = 150, 6000, 96, 1536, 3, 192
#: Floats of the largest array that scoring makes.
ROOM = 8 << 20


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts plus one, A-Z lower-cased, and where each text begins (and the end)."""
    x = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.int16) + 1
    return x, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)


def windows(begins: np.ndarray, own: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window where its own bytes and those it reads begin and end, and the first window of each text (and the end)."""
    n = -(-np.diff(begins) // own)
    first = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    start = begins[text] + (np.arange(first[-1]) - first[text]) * own
    end = np.minimum(start + own, begins[text + 1])
    return start, end, np.maximum(start - context, begins[text]), np.minimum(end + context, begins[text + 1]), first


def matrix(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs of letters as columns, steps x runs; 0 where a run is over."""
    at = start + np.arange(int((end - start).max()) if len(start) else 0)[:, None]
    out = np.take(x, at, mode="clip") if len(x) else np.zeros(at.shape, np.int16)
    out[at >= end] = 0
    return out


_LETTER = np.zeros(257, bool)
_LETTER[[*range(98, 124), *range(129, 257)]] = True
_BLANK = np.concatenate([[True], SPACES])


def grams(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Each letter with the two before it in its word (0 before the word), as a number below 257**3."""
    new = np.zeros(len(x) + 1, bool)
    new[begins] = True
    blank = _BLANK[x]
    new[1:-1] |= blank[:-1] & ~blank[1:]
    new = new[:-1]
    one, two = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    one[1:] = np.where(new[1:], 0, x[:-1])
    two[1:] = np.where(new[1:], 0, one[:-1])
    return (two * 257 + one) * 257 + x


class Spelling:
    """Which letters, after the two bytes before them, the learned texts of any language hold.

    `usual` is the median over the learned texts of the share of their bytes that another of them explains, so
    that a small sample, which explains little of any text, rejects little.
    """

    def __init__(self, texts: list[list[bytes]]):
        read = [letters(t) for t in texts]
        each = [np.unique(grams(x, begins)[_LETTER[x]]) for x, begins in read]
        self.known, times = np.unique(np.concatenate(each), return_counts=True)
        often = self.known[times > 1]
        self.usual = float(np.median([np.isin(grams(x, begins)[_LETTER[x]], often).sum() / max(1, int((~_BLANK[x]).sum())) for x, begins in read]))

    def table(self) -> np.ndarray:
        out = np.zeros(257**3, bool)
        out[self.known] = True
        return out


def _alive(size: np.ndarray, steps: int) -> np.ndarray:
    """How many runs, the longest first, have a byte at each step."""
    return np.searchsorted(-size, -np.arange(steps), side="left")


class Network:
    """Two gated recurrent layers, one over each direction, and a softmax over both states at each byte."""

    def __init__(self, labels: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        f = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
        self.p = {"emb": f(257, EMBED, by=0.5), "out": f(2 * HIDDEN, labels, by=0.2), "bout": np.zeros(labels, np.float32)}
        for d in ("f", "b"):
            self.p |= {f"w{d}": f(EMBED, 3 * HIDDEN, by=EMBED**-0.5), f"u{d}": f(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _read(self, d: str, x: np.ndarray, alive: np.ndarray, keep: bool):
        """States after each byte, steps x columns; alive[t] columns have a byte at step t (the longest come first)."""
        p, k = self.p, HIDDEN
        # sigmoid(v) is (tanh(v / 2) + 1) / 2: the halves go into the weights of both gates
        half = np.concatenate([np.full(2 * k, 0.5), np.ones(k)]).astype(p["emb"].dtype)
        g, u = (p["emb"] @ p[f"w{d}"] + p[f"c{d}"]) * half, p[f"u{d}"] * half
        steps, n = x.shape
        h, states, gates = np.zeros((n, k), g.dtype), np.zeros((steps, n, k), g.dtype), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = int(alive[t])
            old = h[:m]
            a, r = np.take(g, x[t, :m], 0), old @ u
            zr = a[:, : 2 * k] + r[:, : 2 * k]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            new = zr[:, k:] * r[:, 2 * k :]
            new += a[:, 2 * k :]
            np.tanh(new, out=new)
            now = states[t, :m]
            np.subtract(old, new, out=now)
            now *= zr[:, :k]
            now += new
            if keep:
                gates.append((t, m, old, zr, new, r[:, 2 * k :]))
                h = np.zeros((n, k), g.dtype)
            h[:m] = now
        return states, gates

    def label(self, x: np.ndarray, alive: np.ndarray, keep: bool = False):
        """Log probabilities of the labels at each byte, and what they come from."""
        f, gf = self._read("f", x, alive, keep)
        b, gb = self._read("b", x, alive, keep)
        both = np.concatenate([f, b], 2)
        z = both @ self.p["out"] + self.p["bout"]
        z -= z.max(2, keepdims=True)
        z -= np.log(np.exp(z).sum(2, keepdims=True))
        return z, both, gf, gb

    def evidence(self, x: np.ndarray, start: np.ndarray, end: np.ndarray, read: np.ndarray, until: np.ndarray) -> np.ndarray:
        """For each window, the sums over its own bytes of the labels' log probabilities."""
        size = until - read
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(start), len(self.p["bout"])), np.float32)
        at = 0
        while at < len(order):
            steps = int(size[order[at]])
            rows = order[at : at + max(16, ROOM // (steps * (3 * HIDDEN + out.shape[1])))]
            at += len(rows)
            m = matrix(x, read[rows], until[rows])
            z = self.label(m, _alive(size[rows], steps))[0]
            step, skip = np.arange(steps)[:, None], read[rows]
            np.maximum(z, np.float32(np.log(1e-6)), out=z)
            z *= ((step >= start[rows] - skip) & (step < end[rows] - skip))[:, :, None]
            out[rows] = z.sum(0)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean log loss over all bytes of the columns x (longest first) with labels y."""
        p, k = self.p, HIDDEN
        size = (x > 0).sum(0)
        z, both, gf, gb = self.label(x, _alive(size, len(x)), True)
        np.exp(z, out=z)
        z[:, np.arange(len(y)), y] -= 1
        z *= ((x > 0) / max(1, int(size.sum())))[:, :, None].astype(z.dtype)
        flat = z.reshape(-1, z.shape[2])
        g = {"out": both.reshape(-1, 2 * k).T @ flat, "bout": flat.sum(0), "emb": np.zeros_like(p["emb"])}
        back = z @ p["out"].T
        order = np.argsort(x.ravel(), kind="stable")
        seen, first = np.unique(x.ravel()[order], return_index=True)
        for d, gates, ds in (("f", gf, back[:, :, :k]), ("b", gb, back[:, :, k:])):
            du, dh = np.zeros_like(p[f"u{d}"]), np.zeros((len(y), k), z.dtype)
            dg, ut = np.zeros((*x.shape, 3 * k), z.dtype), np.ascontiguousarray(p[f"u{d}"].T)
            for t, m, old, zr, new, rec in reversed(gates):
                total = dh[:m] + ds[t, :m]
                zz, r = zr[:, :k], zr[:, k:]
                now, drec = dg[t, :m], np.empty((m, 3 * k), z.dtype)
                dn = total * (1 - zz) * (1 - new * new)
                now[:, :k], now[:, k : 2 * k], now[:, 2 * k :] = total * (old - new) * zz * (1 - zz), dn * rec * r * (1 - r), dn
                drec[:, : 2 * k], drec[:, 2 * k :] = now[:, : 2 * k], dn * r
                du += old.T @ drec
                dh[:m] = total * zz + drec @ ut
            by_byte = np.zeros((257, 3 * k), z.dtype)
            by_byte[seen] = np.add.reduceat(dg.reshape(-1, 3 * k)[order], first)
            g[f"u{d}"], g[f"c{d}"] = du, by_byte.sum(0)
            g[f"w{d}"] = p["emb"].T @ by_byte
            g["emb"] += by_byte @ p[f"w{d}"].T
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02) -> None:
        """Learns labelled runs of bytes in batches of similar lengths."""
        rng = np.random.default_rng(9)
        x, begins = letters(texts)
        size = np.diff(begins)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        n, total = 0, max(1, epochs * -(-len(texts) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            order = order[np.argsort(-(size[order] // 16), kind="stable")]
            for at in rng.permutation(np.arange(0, len(texts), batch)):
                i = order[at : at + batch]
                i = i[np.argsort(-size[i], kind="stable")]
                n += 1
                step = rate * (1 - 0.9 * n / total)
                for k, g in self.gradients(matrix(x, begins[i], begins[i + 1]), y[i]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= step / (1 - 0.9**n) * m[k] / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)


def cut(raw: bytes, size: int = FIT_WINDOW) -> list[bytes]:
    """A text in windows of about `size` bytes, each from the beginning of a word; words of over `size` bytes are cut."""
    space = SPACES[np.frombuffer(raw, np.uint8)]
    words = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    goal = np.arange(size, len(raw), size)
    at = np.append(words, len(raw))[np.searchsorted(words, goal)]
    edges = np.unique(np.concatenate([[0], np.where(at - goal < size, at, goal), [len(raw)]]))
    return [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def _draw(most_bytes: int):
    """The windows of each text, or some of up to most_bytes bytes, drawn from all of it by a seed of the text's hash."""

    def run(batches):
        for x in batches:
            drawn = []
            for h, text in zip(x["h"], x["text"], strict=True):
                parts = cut(text.encode("utf-8", "surrogatepass"))
                order = np.random.default_rng(int(h) & (2**63 - 1)).permutation(len(parts))
                sizes = np.cumsum([len(parts[i]) for i in order])
                drawn.append([parts[i] for i in np.sort(order[: max(1, np.searchsorted(sizes, most_bytes, side="right"))])])
            yield pd.DataFrame({"lang": x["lang"], "h": x["h"], "parts": drawn})

    return run


def fit(labelled: DataFrame, documents: int = FIT_DOCUMENTS, most_rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> tuple[list[str], Network | None]:
    """Fits a network to a bounded sample of (text, lang) rows: of every language, the first different texts by their hash.

    At most `documents` of a language, fewer where the languages are so many that all would come to more than
    most_rows, but one at least: max(most_rows, languages) rows of about most_bytes bytes reach the driver.
    """
    rows = labelled.where("lang is not null and text is not null and length(text) > 0").select("lang", F.xxhash64("text").alias("h"), "text")
    # ranked in shares of a language first, so that a common one is not ranked in one task
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    shares = rows.select("lang", "h").distinct().withColumn("s", F.pmod("h", F.lit(64)))
    shares = shares.withColumn("nth", nth("lang", "s")).where(F.col("nth") <= documents)
    first = store(shares.withColumn("nth", nth("lang")).where(F.col("nth") <= documents).select("lang", "h", "nth"), "sample")
    languages = first.where("nth = 1").count()
    first_of_each = first.where(F.col("nth") <= max(1, most_rows // max(1, languages))).select("lang", "h")
    chosen = rows.join(F.broadcast(first_of_each), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = sorted(chosen.mapInPandas(_draw(most_bytes), "lang string, h long, parts array<binary>").collect(), key=lambda r: (r["lang"], r["h"]))
    drop(first)
    names = sorted({r["lang"] for r in got})
    if not names:
        return [], None
    number = {name: i for i, name in enumerate(names)}
    texts = [[bytes(b) for b in r["parts"]] for r in got]
    net = Network(len(names))
    net.spelling = Spelling(texts)
    net.fit([p for t in texts for p in t], np.concatenate([np.full(len(t), number[r["lang"]]) for r, t in zip(got, texts, strict=True)]))
    return names, net


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of runs of rows, runs first[i]..first[i + 1]."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    return np.diff(np.concatenate([np.zeros((1, *values.shape[1:]), kind), np.cumsum(values, 0, dtype=kind)])[first], axis=0)


def _predict(shared, explained: str | None):
    def run(batches):
        names, net = shared.value
        spelt = net.spelling.table() if explained and net is not None else None
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            rest = batch.select([c for c in batch.schema.names if c != "__text"])
            for a, b in pieces(texts, 8 << 20):
                worded = np.array([t is not None and (any(c in t for c in "aeinrst") or any(map(str.isalpha, t))) for t in texts[a:b]])
                raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
                x, begins = letters(raw)
                pooled, share = np.zeros((b - a, max(1, len(names)))), np.zeros(b - a)
                if net is not None and len(x):
                    *spans, first = windows(begins)
                    pooled = _sums(net.evidence(x, *spans), first)
                    if spelt is not None:
                        known, full = (_sums(v, begins) for v in (spelt[grams(x, begins)] & _LETTER[x], ~_BLANK[x]))
                        usual = net.spelling.usual
                        share = np.minimum(1, known / np.maximum(1, full) / usual) if usual else np.ones(b - a)
                size = np.maximum(1, np.array([len(r) for r in raw]))
                # the bytes of a document are not independent: the pooled logarithms count as sqrt(n) votes
                z = pooled / np.sqrt(size)[:, None]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                best = z.argmax(1)
                ok = worded & (net is not None)
                named = pa.array([names[i] if g else UNKNOWN for i, g in zip(best, ok, strict=True)], pa.string())
                score = pa.array(np.where(ok, z[np.arange(b - a), best], 0.0), pa.float64())
                more = [(explained, pa.array(np.where(ok, share, 0.0), pa.float64()))] if explained else []
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, named, score, *(v for _, v in more)], [*rest.schema.names, "lang_pred", "score", *(k for k, _ in more)])

    return run


def identify(docs: DataFrame, held_out: Column, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, explained: str | None = None) -> DataFrame:
    """Adds held_out, lang_pred and score to the columns `carry` of the documents (all, unless given).

    The network is fitted to rows for which held_out is false and whose language is not null; predictions come
    from the texts alone. Null texts and texts without a letter are "und" with the score 0, and so is all if
    there is nothing to learn from. Repeated rows fare alike; an empty table gives an empty table; columns named
    held_out, lang_pred or score in the input are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs.where(~held_out).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))))
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("held_out", "lang_pred", "score")]
    slim = docs.select(*kept, held_out.alias("held_out"), F.col(text_col).alias("__text"))
    kind = T.StructType([f for f in slim.schema.fields if f.name != "__text"]).add("lang_pred", "string").add("score", "double")
    if explained:
        kind = kind.add(explained, "double")
    return slim.mapInArrow(_predict(shared, explained), kind)


def op7_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), crc_mod("doc_id", 4) == 2, carry=["doc_id"])
