"""Document quality by pairwise ranking: Bradley-Terry scores learnt from preference pairs, cut at a quantile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, crc_mod, drop, held_id, pieces, real_id, small_batches, store, table

#: Each labelled document is set against so many of the other label; every text is scored whole.
RIVALS = 12
#: Passes over the pairs at most, the ridge, labelled documents of a shard, of its rarer label at least, and the unit of sums.
PASSES, RIDGE, SHARD, FEW, GRAIN = 30, 1e-3, 2000, 64, 2.0**-20
#: Bins of a count, and values that are sorted at once.
BINS, HELD = 4096, 10_000

_LOWER, _UPPER, _DIGIT, _MARK, _HIGH, _LINE = range(6)
_KIND = np.full(256, _MARK, np.int8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[10] = _LOWER, _UPPER, _DIGIT, _HIGH, _LINE
_KIND[[32, 9, 11, 12, 13]] = 6
_COMMON_MARKS = np.isin(np.arange(256), list(b".,;:'-"))


def with_roots(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(x, 0))], 1)


def features(texts: list[str | None]) -> np.ndarray:
    """What the scorer reads of each whole text: its figures and their roots."""
    return with_roots(figures(texts))


def figures(texts: list[str | None]) -> np.ndarray:
    """One row of figures for each whole text; a null or empty text has zeros."""
    out = []
    for a, b in pieces(texts):
        w = Words(texts[a:b])
        n = b - a
        raw = np.frombuffer(b" ".join([*(b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts[a:b]), b""]), np.uint8)
        begin = np.concatenate([[0], np.cumsum(w.bytes + 1)])[:-1]
        kind = np.take(_KIND, raw)
        per = lambda mask: np.add.reduceat(mask.astype(np.int32), begin) if len(begin) else np.zeros(0)
        size, count = np.maximum(w.bytes, 1), np.maximum(w.count, 1)
        letters = per(kind == _LOWER) + per(kind == _HIGH)
        upper = per(kind == _UPPER)
        odd = per((kind == _MARK) & ~np.take(_COMMON_MARKS, raw))
        doc = np.repeat(np.arange(n), w.count)
        ends = np.take(_KIND, w.buf[w.end - 1]) if len(w.end) else np.zeros(0, np.int8)
        odd_end = (ends == _MARK) & ~np.take(_COMMON_MARKS, w.buf[w.end - 1]) if len(w.end) else np.zeros(0, bool)
        alone = odd_end & (w.end - w.start == 1)
        again = np.zeros(len(doc), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        distinct, top = np.zeros(n), np.zeros(n)
        for d in range(n):
            if w.count[d]:
                c = np.unique(w.hash[w.first[d] : w.first[d + 1]], return_counts=True)[1]
                distinct[d], top[d] = len(c), c.max()
        by_doc = lambda m: np.bincount(doc, m, n) / count
        out.append(np.stack([
            np.log1p(w.count), letters / size, upper / np.maximum(1, letters + upper), per(kind == _DIGIT) / size, odd / size,
            per(kind == _LINE) / count, np.bincount(doc, w.end - w.start, n) / count / 10, distinct / np.maximum(1, count**0.8), top / count * (w.count > 0),
            by_doc(odd_end), by_doc(alone), by_doc(again), (w.count == 0).astype(float),
        ], 1))
    return np.concatenate(out) if out else np.zeros((0, 13))


def pairs(z: np.ndarray, label: np.ndarray) -> np.ndarray:
    """What each document has over RIVALS of the other label, or these over it: differences of good to bad ones."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label != 1)
    if not (len(good) and len(bad)):
        return np.zeros((0, z.shape[1]))
    rng = np.random.default_rng(4)
    i = np.concatenate([np.repeat(good, RIVALS), rng.choice(good, len(bad) * RIVALS)])
    j = np.concatenate([rng.choice(bad, len(good) * RIVALS), np.repeat(bad, RIVALS)])
    return z[i] - z[j]


def sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over pairs: their number, the loss, its gradient and its second derivatives, as one row of figures."""
    at = np.clip(d @ w, -30, 30)
    miss = 1 / (1 + np.exp(at))
    return np.concatenate([[len(d), np.log1p(np.exp(-at)).sum()], -(miss @ d), ((d * (miss * (1 - miss))[:, None]).T @ d).ravel()])


def newton(measure, width: int) -> np.ndarray:
    """The weights of least loss (with a ridge, so there is one), by Newton's steps, halved where the loss would rise.

    measure(w): the sums over all pairs.
    """
    w, step, least, best = np.zeros(width), np.zeros(width), np.inf, None
    for _ in range(PASSES):
        s = measure(w + step)
        n = max(1.0, s[0])
        loss = s[1] / n + RIDGE / 2 * float((w + step) @ (w + step))
        if loss > least + 1e-9:
            step = step / 2
            continue
        w, gain, least = w + step, least - loss, loss
        best = (s[2 : 2 + width] / n + RIDGE * w, s[2 + width :].reshape(width, width) / n + RIDGE * np.eye(width))
        if gain < 1e-7:
            break
        step = -np.linalg.solve(best[1], best[0])
    return w


class Ranker:
    """P(i is preferred to j) = sigmoid(s(i) - s(j)), s linear in standardised features; `cut` and `scale` make a probability."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        d = pairs(self.standard(x), label)
        self.w = newton(lambda w: sums(d, w), x.shape[1])

    @classmethod
    def of(cls, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> Ranker:
        made = cls.__new__(cls)
        made.mean, made.spread, made.w = mean, spread, w
        return made

    def calibrate(self, x: np.ndarray, label: np.ndarray, low: float) -> None:
        """The cut is the quantile of the scores that has the share `low` of the labelled documents below it."""
        s = np.sort(self.rank(x))
        at = place_of(low, len(s))
        self.cut = float((s[at - 1] + s[at]) / 2) if len(s) > 1 else float(s[0])
        self.scale = float(max(np.median(np.abs(s - self.cut)) / 3, 1e-6))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.rank(x) - self.cut) / self.scale, -500, 500)))


def place_of(low: float, n: int) -> int:
    """How many of n sorted scores are below the cut."""
    return min(max(round(low * n), 1), n - 1) if n > 1 else 0


def _figures(batches):
    for x in batches:
        texts = x["text"].tolist()
        for a, b in pieces(texts, 4 << 20):
            yield x.iloc[a:b].drop(columns="text").assign(x=list(figures(texts[a:b])))


def _held(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), float).reshape(len(x), -1)


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's documents in the order of a hash, as one row."""
    rows = rows.sort_values(["h", "doc_id"])
    return pd.DataFrame({"x": [_held(rows["x"]).tobytes()], "label": [rows["quality"].to_numpy(np.int8).tobytes()]})


def _total(shards: DataFrame, measure) -> np.ndarray:
    """The sum over shards of measure(x, label), as whole multiples of GRAIN, so that it is the same in any order."""

    def run(batches):
        total = 0
        for rows in batches:
            for x, label in zip(rows["x"], rows["label"], strict=True):
                label = np.frombuffer(label, np.int8)
                total = total + np.rint(measure(with_roots(np.frombuffer(x).reshape(len(label), -1)), label) / GRAIN).astype(np.int64)
        if not np.isscalar(total):
            yield pd.DataFrame({"pos": np.arange(len(total)), "v": total})

    got = shards.mapInPandas(run, "pos int, v long").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["pos"])], float) * GRAIN


def nth(rows: DataFrame, column: str, k: int) -> float:
    """The k-th least value (from 0), by counts in ever narrower bins: no task and not the driver sorts more than HELD values."""
    v, found = F.col(column), rows
    while True:
        low, high, n = found.agg(F.min(v), F.max(v), F.count(v)).first()
        if low == high:
            return low
        if n <= HELD:
            return sorted(r[0] for r in found.select(v).collect())[k]
        bin_ = F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1))
        for b, many in sorted(map(tuple, found.groupBy(bin_.alias("b")).agg(F.count("*")).collect())):
            if k < many:
                found = found.where(bin_ == b)
                break
            k -= many


def fit(rows: DataFrame, labels: DataFrame) -> Ranker | float:
    """Learns from all labels (doc_id, quality) of rows (doc_id, h, x: figures of a text and its hash); with one label only, or none, its share is all there is.

    Documents are dealt by hash to shards of about SHARD, within which each is set against RIVALS of the other label; where a shard
    would have few of the rarer label, its documents stand in several. The tasks sum over the pairs of their shards.
    """
    labels = labels.where("doc_id is not null and quality is not null").withColumn("quality", (F.col("quality") == 1).cast("int")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # a labelled id given more than once counts once, with one of its texts
    one = rows.join(labels, "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("text"), F.max("quality").alias("quality"))
    known = store(one.select("doc_id", "quality", F.xxhash64("doc_id").alias("h"), F.col("text.x").alias("x")), "labelled")
    many = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n = sum(many.values())
    if len(many) < 2:
        drop(known)
        return float(next(iter(many))) if many else 0.5
    count = max(1, round(n / SHARD))
    rare = min(many, key=lambda q: (many[q], q))
    spare = min(count, -(-FEW * count // many[rare]))  # shards of a document of the rarer label: one unless it is rare
    dealt = known.withColumn("i", F.explode(F.when(F.col("quality") == rare, F.sequence(F.lit(0), F.lit(spare - 1))).otherwise(F.array(F.lit(0)))))
    dealt = dealt.withColumn("shard", F.pmod(F.col("h") + F.col("i") * (count // spare), F.lit(count)))
    shards = store(dealt.groupBy("shard").applyInPandas(_gather, "x binary, label binary"), "shards")
    first = _total(shards, lambda x, label: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    width = (len(first) - 1) // 2
    mean = first[1 : 1 + width] / first[0]
    spread = np.sqrt(np.maximum(first[1 + width :] / first[0] - mean * mean, 0)) + 1e-3
    ranker = Ranker.of(mean, spread, np.zeros(width))
    ranker.w = newton(lambda w: _total(shards, lambda x, label: sums(pairs(ranker.standard(x), label), w)), width)

    def ranks(batches):
        for x in batches:
            yield pd.DataFrame({"s": ranker.rank(with_roots(_held(x["x"])))})

    ranked = store(known.select("x").mapInPandas(ranks, "s double"), "ranks")
    at = place_of(many[0] / n, n)
    ranker.cut = (nth(ranked, "s", at - 1) + nth(ranked, "s", at)) / 2
    off = ranked.select(F.abs(F.col("s") - ranker.cut).alias("s"))
    ranker.scale = max((nth(off, "s", (n - 1) // 2) + nth(off, "s", n // 2)) / 6, 1e-6)
    drop(known, shards, ranked)
    return ranker


def _score(shared):
    def run(batches):
        ranker = shared.value
        for x in batches:
            s = np.full(len(x), ranker) if isinstance(ranker, float) else ranker.probability(with_roots(_held(x["x"])))
            yield pd.DataFrame({"doc_id": x["doc_id"].to_numpy(), "held_out": x["held_out"].to_numpy(), "score": s, "predicted": (s >= 0.5).astype(int)})

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Learns from all labels of documents for which held_out (a column of doc_id) is false. Scores come from the text
    alone; null and empty texts are scored by their (zero) features. Repeated rows fare alike; a label given
    twice counts as 1 if any is; of several texts of one labelled id one is learned; an empty table gives an empty table; without both labels the score is the
    labels' share. Columns other than doc_id, text and quality are not read. Texts are read once: their figures (104 bytes each) are stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(held_id("doc_id").alias("doc_id"), held_out.alias("held_out"), F.xxhash64("text").alias("h"), "text")
    rows = store(docs.mapInPandas(_figures, "doc_id long, held_out boolean, h long, x array<double>"), "figures")
    ranker = fit(rows.select("doc_id", "h", "x"), labels.select("doc_id", "quality").where(~held_out))
    shared = spark.sparkContext.broadcast(ranker)
    out = rows.mapInPandas(_score(shared), "doc_id long, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", real_id("doc_id"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), crc_mod("doc_id", 3) == 1)
