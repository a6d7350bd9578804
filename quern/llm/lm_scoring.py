"""Language-model scoring: a gated recurrent model over words, trained and applied on the executors.

The vocabulary is every word of the training texts, counted over all of them. The HEAD most frequent words
have outputs of their own in classes of CLASS words; every other word belongs to a tail class by its last
bytes, and a tail word's probability is that of its class, given all that the text has had so far, times its
share of the class's count. Each tail class keeps a Good-Turing share for words never seen.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import gru_lm as G
from quern.llm.common import Words, crc_mod, drop, held_id, pieces, real_id, small_batches, store, table

#: Counts that every worker gets (16 bytes each, so 4 MB at most); rarer words are joined by their hash.
KNOWN = 1 << 18
#: Training documents fall into CLASSES by hash; each round of training reads some of these classes, and the rounds
#: together read each training document once. There are as many rounds as shards allow, EACH of these to a round; few
#: shards, up to APART, are read one after the other.
CLASSES, EACH, APART = 16, 2, 8
#: Tokens of a shard (one training run), tokens that training reads from one zero state on, tasks of a round at
#: most, weights of one row, and the unit in which weights are added.
SHARD, SECTION, TASKS, PART, GRAIN = 1 << 18, 2048, 10_000, 4096, 2.0**-48
SMOOTH = 0.1
_SUFFIX = np.random.default_rng(11).integers(0, G.TAIL, 1 << 16).astype(np.uint64)
_BITS = np.uint64(5)


def keys(w: Words) -> np.ndarray:
    """59 bits of each word's hash, then 5 bits of its tail class, which its last two bytes choose."""
    last = w.buf[w.end - 1].astype(np.int64)
    prior = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (w.hash << _BITS) | _SUFFIX[(prior << 8) | last]


class Lookup:
    """Values of sorted 64-bit keys, found by their high bits."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.shift = np.uint64(64 - max(1, int(len(key)).bit_length()))
        self.at = np.searchsorted(self.key >> self.shift, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int64)
        self.key = np.concatenate([self.key, np.zeros(1, np.uint64)])
        self.run = int(np.bincount((self.key[:-1] >> self.shift).astype(np.int64)).max()) if len(key) else 0

    def find(self, key: np.ndarray) -> np.ndarray:
        """Places in `value`, -1 where a key is missing."""
        out = np.full(len(key), -1, np.int64)
        at, left = np.take(self.at, (key >> self.shift).astype(np.int64)), np.arange(len(key))
        last = len(self.key) - 1
        for _ in range(self.run):
            hit = np.take(self.key, at) == key[left]
            hit &= at < last
            out[left[hit]] = at[hit]
            left, at = left[~hit], np.minimum(at[~hit] + 1, last)
            if not len(left):
                break
        return out


def _count(batches):
    for x in batches:
        texts = x["text"].tolist()
        found = [keys(Words(texts[a:b])) for a, b in pieces(texts)]
        key, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pd.DataFrame({"key": key.view(np.int64), "n": n})


class Vocabulary:
    """What every worker needs: the most frequent words' keys and counts, and the tail classes' totals."""

    def __init__(self, key, count, totals, n_docs: int):
        """key and count: of the most frequent words, in order; totals: class -> (counts, words, words met once)."""
        self.key, self.count, self.docs = key, count, n_docs
        words, seen, types, once = int(n_docs > 0), n_docs, np.zeros(G.TAIL), np.zeros(G.TAIL)
        counts = np.zeros(G.TAIL)
        for c, (n, v, one) in totals.items():
            counts[c], types[c], once[c] = n, v, one
        seen, words = seen + int(counts.sum()), words + int(types.sum())
        self.tokens, self.size = seen, words
        self.norm = seen + SMOOTH * (words + 1)
        head = key[: G.HEAD]
        inside = (head & np.uint64(31)).astype(np.int64)
        tail_counts = counts - np.bincount(inside, count[: G.HEAD], G.TAIL)
        tail_types = types - np.bincount(inside, minlength=G.TAIL)
        tail_once = once - np.bincount(inside, count[: G.HEAD] == 1, G.TAIL)
        self.unseen = np.where(tail_counts > 0, np.clip(tail_once / np.maximum(tail_counts, 1), 1e-6, 0.5), 1.0)
        self.mass = np.maximum(tail_counts + SMOOTH * tail_types, SMOOTH)
        by_class = np.zeros(G.CLASSES)
        by_class[: G.HEAD_CLASSES] = np.bincount(np.arange(len(head)) // G.CLASS, count[: G.HEAD], G.HEAD_CLASSES)
        by_class[G.HEAD_CLASSES : -1], by_class[-1] = tail_counts, n_docs
        self.by_class = by_class

    def tail_logs(self) -> tuple[list[float], list[float]]:
        """For each tail class: log10 of what a count plus SMOOTH is divided by, and log10 of an unseen word's share."""
        return list(map(float, np.log10(self.mass) - np.log10(np.maximum(1 - self.unseen, 1e-12)))), list(map(float, np.log10(self.unseen)))


def _ids(w: Words, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model inputs of the texts with their ends, and where each text begins; place: each word's rank, or -1."""
    first = np.concatenate([[0], np.cumsum(w.count + 1)])
    out = np.full(first[-1], G.END, np.int32)
    inner = np.ones(first[-1], bool)
    inner[first[1:] - 1] = False
    out[inner] = np.where((place >= 0) & (place < G.HEAD), place, G.HEAD + (key & np.uint64(31)).astype(np.int64))
    return out, first


def _rank(find: Lookup, key: np.ndarray) -> np.ndarray:
    at = find.find(key)
    return np.where(at >= 0, find.value[at] if len(find.value) else -1, -1)


def _learn(shared, shards: int):
    """Trains on each shard (rows of one shard come together, in order) and yields the sum over a task's shards.

    A shard's weights count as its part of all tokens and are added as whole multiples of GRAIN, so that the sum
    is the same in whatever order and grouping shards meet.
    """

    def run(batches):
        start, total = shared.value
        mean, read = np.zeros(G.SIZE, np.int64), 0

        def end(held: list[bytes]) -> None:
            nonlocal mean, read
            flat = start.copy()
            ids, first = sections([np.frombuffer(x, "<i2") for x in held])
            n = G.train(flat, ids, first, {})
            mean += np.rint(flat.astype(np.float64) * (n / total) / GRAIN).astype(np.int64)
            read += n

        now, held = None, []
        for x in batches:
            for shard, ids in zip(x["shard"].tolist(), x["ids"], strict=True):
                if held and shard != now:
                    end(held)
                    held = []
                now = shard
                held.append(ids)
        if held:
            end(held)
        if read:
            yield _parts(mean, read, int(now) % max(1, math.isqrt(shards)))

    return run


def _parts(mean: np.ndarray, read: int, salt: int) -> pd.DataFrame:
    cut = [mean[i : i + PART] for i in range(0, G.SIZE, PART)]
    return pd.DataFrame({"part": np.arange(len(cut)), "salt": salt, "weights": cut, "read": read})


def sections(texts: list[np.ndarray], most: int = SECTION) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each section begins: texts, or runs of `most` ids of longer ones."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(1, -(-sizes // most))
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.append(np.repeat(begins, n) + nth * most, sizes.sum())
    return np.concatenate(texts).astype(np.int32), first


def _add(batches):
    """Sums rows of one part each; whole numbers, so in any order."""
    sums: dict[int, list] = {}
    for x in batches:
        for part, weights, read in zip(x["part"], x["weights"], x["read"], strict=True):
            have = sums.setdefault(part, [0, 0])
            have[0], have[1] = have[0] + weights, have[1] + read
    for part, (weights, read) in sums.items():
        yield pd.DataFrame({"part": [part], "salt": [0], "weights": [weights], "read": [read]})


def rounds_for(shards: int) -> list[tuple[int, int]]:
    """Ranges of classes, of about equal size: more rounds the more there is to learn from."""
    n = max(1, min(CLASSES, max(shards // EACH, min(shards, APART))))
    return [(CLASSES * i // n, CLASSES * (i + 1) // n) for i in range(n)]


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: list[tuple[int, int]] | None = None, shard_tokens: int | None = None) -> np.ndarray:
    """Trains on (doc_id, ids) rows: in each round, every shard passes over its documents from the same weights, and
    the mean, weighted by tokens, starts the next.

    Shards are made by hash, as many as the training tokens ask for, and read in the order of a hash; means are
    exact sums. So the weights depend on the rows alone, not on partitions, cores or the order of rows. Rows equal
    in id and ids are numbered and dealt like others. The executors sum; the driver gets one set of weights.
    """
    flat = G.initial(vocabulary.count[: G.HEAD], vocabulary.by_class)
    sc = encoded.sparkSession.sparkContext
    copies = encoded.groupBy("doc_id", "ids").agg((F.count("*") - 1).alias("n")).withColumn("k", F.explode(F.expr("sequence(0L, n div 10000)")))
    copies = copies.withColumn("copy", F.explode(F.expr("sequence(k * 10000, least(n, k * 10000 + 9999))")))
    dealt = store(copies.select("ids", F.xxhash64("doc_id", "ids", "copy").alias("h")), "dealt")
    share = F.pmod(F.col("h"), F.lit(CLASSES))
    kind = "part int, salt int, weights array<long>, read long"
    tokens = dict(dealt.groupBy(share.alias("c")).agg(F.sum(F.length("ids") / 2).cast("long").alias("n")).collect())
    for low, high in rounds or rounds_for(round(sum(tokens.values()) / (shard_tokens or SHARD))):
        total = sum(n for c, n in tokens.items() if low <= c < high)
        if not total:
            continue
        shards = max(1, round(total / (shard_tokens or SHARD)))
        shared = sc.broadcast((flat, total))
        rows = dealt.where((share >= low) & (share < high)).withColumn("shard", F.pmod(F.shiftright("h", 4), F.lit(shards)))
        tasks = min(shards, TASKS)
        rows = rows.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "h").select("shard", "ids")
        made = rows.mapInPandas(_learn(shared, shards), kind)
        parts = made.repartition("part", "salt").mapInPandas(_add, kind).repartition("part").mapInPandas(_add, kind).collect()
        flat = np.concatenate([np.array(r["weights"], np.int64) * GRAIN for r in sorted(parts, key=lambda r: r["part"])]).astype(np.float32)
        shared.unpersist()
    drop(dealt)
    return flat


def _encode(shared):
    """Texts -> what training and scoring read of them: model inputs, sums over known words, the rare words and their numbers."""

    def run(batches):
        v = shared.value
        find = Lookup(v.key, np.arange(len(v.key)))
        logs = np.log10(np.maximum(v.count, 1) + SMOOTH)
        inside = (v.key & np.uint64(31)).astype(np.int64)
        share = np.array(v.tail_logs()[0])
        of_tail = np.where(np.arange(len(v.key)) < G.HEAD, 0.0, logs - share[inside])
        logs, of_tail = np.append(logs, 0.0), np.append(of_tail, 0.0)
        end = np.log10(v.docs + SMOOTH)
        for x in batches:
            texts = x["text"].tolist()
            for i, j in pieces(texts):
                w = Words(texts[i:j])
                key = keys(w)
                place = _rank(find, key)
                ids, first = _ids(w, key, place)
                doc = np.repeat(np.arange(j - i), w.count)
                rare = np.flatnonzero(place < 0)
                cut = np.searchsorted(rare, w.first)
                unique = [np.unique(key[rare[a:b]], return_counts=True) for a, b in zip(cut, cut[1:], strict=False)]
                ids = ids.astype("<i2").tobytes()
                yield pd.DataFrame({
                    "doc_id": x["doc_id"].iloc[i:j].to_numpy(), "held_out": x["held_out"].iloc[i:j].to_numpy(), "n_tokens": (w.count + 1).astype(np.int64),
                    "n_known": np.bincount(doc, place >= 0, j - i).astype(np.int64) + int(v.docs > 0), "base": np.bincount(doc, logs[place], j - i) + end, "tail": np.bincount(doc, of_tail[place], j - i),
                    "ids": [ids[2 * a : 2 * b] for a, b in zip(first, first[1:], strict=False)], "rare": [u.view(np.int64) for u, _ in unique], "times": [n for _, n in unique],
                })

    return run


def _score(shared):
    def run(batches):
        flat = shared.value
        for x in batches:
            held = x["ids"].tolist()
            model = [np.zeros(0)]
            for a, b in pieces(held, 4 << 20):  # many documents, so that a long one does not read on alone for long
                texts = [np.frombuffer(i, "<i2") for i in held[a:b]]
                model.append(G.score(flat, np.concatenate(texts).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])))
            x["model"] = np.concatenate(model)
            yield x.drop(columns="ids")

    return run


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """Words at or above the least count that at most `most` words reach, the most frequent first.

    The count is found on a histogram of logarithms (at most 2048 rows), so that no task and not the driver
    sorts more than `most` words; words of about the same count come all or none.
    """
    level = F.floor(F.log2("n") * 32)
    histogram = sorted(((r["level"], r["v"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect()), reverse=True)
    seen, least = 0, None
    for at, n in histogram:
        seen += n
        if seen > most:
            break
        least = at
    rows = counts.where(level >= F.lit(least) if least is not None else F.lit(False)).toPandas()
    return rows.sort_values(["n", "key"], ascending=[False, True], ignore_index=True)


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    held_out: a column that is true for documents not to learn from. Null and empty texts hold the end alone.
    With no training documents every word is unseen. Repeated rows are scored (and counted) once each; an empty
    table gives an empty table; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(held_id(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    seen = docs.where("not held_out")
    counts = store(seen.select("text").mapInPandas(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    top = most_frequent(counts, KNOWN)
    inside = F.col("key").bitwiseAND(F.lit(31))
    totals = {r["k"]: (r["n"], r["v"], r["one"]) for r in counts.groupBy(inside.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("one")).collect()}
    v = Vocabulary(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.float64), totals, seen.count())
    known = spark.sparkContext.broadcast(v)
    encoded = docs.mapInPandas(_encode(known), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, ids binary, rare array<long>, times array<long>")
    encoded = store(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    weights = spark.sparkContext.broadcast(train(encoded.where("not held_out").select("doc_id", "ids"), v))
    slim = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail", "ids")
    scored = slim.mapInPandas(_score(weights), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, model double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    share, unseen = (F.array(*map(F.lit, x)) for x in v.tail_logs())
    k = inside.cast("int")
    rare = rare.join(counts.where(F.col("n").isNotNull()), "key", "left").select(
        "row",
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("base"),
        (F.col("times") * F.when(F.col("n").isNull(), F.get(unseen, k)).otherwise(F.log10(F.col("n") + SMOOTH) - F.get(share, k))).alias("model"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"),
    )
    rare = rare.groupBy("row").agg(F.sum("base").alias("rare_base"), F.sum("model").alias("rare_model"), F.sum("known").alias("rare_known"))
    out = scored.join(rare, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        real_id("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n_tokens") * float(np.log10(v.norm))).alias("base_score"), (F.col("model") + F.col("tail") + zero("rare_model")).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), crc_mod("doc_id", 10) == 0)
