"""Best-fit packing by linear grouping, planned on a histogram of lengths.

Lengths are whole numbers up to the length of a sequence, so all documents come down to at most that many
counts. The plan is made from those counts alone, whatever their size, and names for each length which
sequences take how many of it; documents of a length then take its places in the order of a hash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import held_id, pieces, real_id, small_batches, store, table

LENGTH, VOCABULARY = 2048, "byte_bpe_50k"
#: Settings that are planned in turn: the number of groups of about equal counts that large lengths form, and the
#: share of a sequence (1 / small) above which a length is large. The plan with the fewest sequences is taken.
SETTINGS = ((24, 2), (24, 4), (48, 4), (24, 8))
#: Documents that are packed together where their order matters.
STRETCH = 1 << 16


# --- tokens -------------------------------------------------------------------------------


class Encoder:
    """Token ids of the byte-level vocabulary, as `tokenizers` gives them.

    Texts of Latin-1 characters alone go through `tiktoken`, which has the same merges and, for these
    characters, the same splitting pattern, at about a quarter of the time; all others, and those that hold an
    added token of the vocabulary (which is one id, as `tokenizers` has it), go through `tokenizers`.
    """

    def __init__(self, name: str = VOCABULARY):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            text.encode("latin-1")
            plain = not any(a in text for a in self.added)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """Where the pieces of n ids begin, and n: pieces of the full length, the first one shorter if need be."""
    return [0, *range(n % length or length, n, length), n]


def _tokenise(length: int, name: str, with_ids: bool):
    def run(batches):
        encode = encoder(name)
        for x in batches:
            texts = x["text"].tolist()
            for a, b in pieces(texts, 2 << 20):
                out: list[tuple] = []
                for doc, turn, text in zip(x["doc_id"].iloc[a:b].tolist(), x["turn"].iloc[a:b].tolist(), texts[a:b], strict=True):
                    ids = np.append(encode(text), np.uint32(0)).astype("<u4")
                    at = cuts(len(ids), length)
                    for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
                        out.append((doc, turn, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), *([ids[i:j].astype(np.int32)] if with_ids else [])))
                cols = ["doc_id", "turn", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pd.DataFrame(out, columns=cols)

    return run


# --- the plan -----------------------------------------------------------------------------


class Shapes:
    """Sequences by shape: a tuple of lengths -> how many sequences are filled so; `room` finds shapes by what is left."""

    def __init__(self, length: int):
        self.length, self.made = length, {}
        self.room: dict[int, dict[tuple, int]] = {}

    def add(self, shape: tuple, n: int) -> None:
        left = self.length - sum(shape)
        assert left >= 0 and n > 0
        at = self.room.setdefault(left, {})
        at[shape] = at.get(shape, 0) + n

    def best(self, size: int, tree: np.ndarray) -> int:
        """The least room of at least size, or -1; tree[r] is the number of sequences with room r."""
        at = np.flatnonzero(tree[size:])
        return size + int(at[0]) if len(at) else -1

    def fill(self, size: int, n: int) -> None:
        """Best fit for n items of a size: the fullest sequences with room first, new ones at last."""
        tree = np.zeros(self.length + 1, np.int64)
        for r, at in self.room.items():
            tree[r] = sum(at.values())
        while n:
            r = self.best(size, tree)
            if r < 0:
                each = self.length // size
                if n >= each:
                    self.add((size,) * each, n // each)
                if n % each:
                    self.add((size,) * (n % each), 1)
                return
            at = self.room[r]
            shape = next(iter(at))
            have = at[shape]
            each = min(r // size, n)  # the fullest stays the fullest until it is full
            take = min(have, n // each)
            if take == have:
                del at[shape]
                if not at:
                    del self.room[r]
            else:
                at[shape] = have - take
            self.add((*shape, *(size,) * each), take)
            tree[r] -= take
            tree[r - each * size] += take
            n -= take * each


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, int, dict[int, int]]]:
    """Linear grouping, longest first: (length rounded up to the group's longest, items, the group's own counts)."""
    total = sum(counts.values())
    out, left, own, filled = [], math.ceil(total / groups) if total else 0, {}, 0
    each = left
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            take = min(n, each - filled)
            own[size] = own.get(size, 0) + take
            filled, n = filled + take, n - take
            if filled == each:
                out.append((max(own), filled, own))
                own, filled = {}, 0
    if filled:
        out.append((max(own), filled, own))
    return out


def configurations(sizes: list[int], demand: list[int], length: int, rounds: int = 60) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations (how many of each size) that use no more than the demand; what is left is for best fit.

    Column generation for the few sizes: the prices of the sizes come from the linear programme over the
    configurations so far, the next configuration is the best one by these prices (an unbounded knapsack),
    until none is worth more than a sequence; then the solution is rounded down.
    """
    k = len(sizes)
    if not k:
        return []
    columns = [tuple(int(i == j) * (length // s) for j in range(k)) for i, s in enumerate(sizes)]
    use = None
    for _ in range(rounds):
        use, price = _cover(np.array(columns, float).T, np.array(demand, float))
        worth, pattern = _knapsack(sizes, price, length)
        if worth <= 1 + 1e-9 or pattern in columns:
            break
        columns.append(pattern)
    left, out = list(demand), []
    for i in np.argsort(-use, kind="stable"):
        pattern = columns[i]
        n = min(int(use[i] + 1e-9), *(left[j] // c for j, c in enumerate(pattern) if c))
        if n > 0:
            out.append((pattern, n))
            left = [a - n * c for a, c in zip(left, pattern, strict=True)]
    return out


def _knapsack(sizes: list[int], price: np.ndarray, length: int) -> tuple[float, tuple[int, ...]]:
    best, last = np.zeros(length + 1), np.full(length + 1, -1)
    for w in range(1, length + 1):
        best[w], last[w] = best[w - 1], -1
        for i, s in enumerate(sizes):
            if s <= w and best[w - s] + price[i] > best[w] + 1e-12:
                best[w], last[w] = best[w - s] + price[i], i
    pattern, w = [0] * len(sizes), length
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[length]), tuple(pattern)


def _cover(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min sum(x), a x >= b, x >= 0 by the revised simplex method from the basis of the first columns; x and the prices."""
    m, n = a.shape
    basis = list(range(m))
    full = np.concatenate([a, -np.eye(m)], 1)
    cost = np.concatenate([np.ones(n), np.zeros(m)])
    for step in range(2000):
        inverse = np.linalg.inv(full[:, basis])
        x = inverse @ b
        price = cost[basis] @ inverse
        reduced = cost - price @ full
        reduced[basis] = 0
        enter = int(np.argmin(reduced)) if step < 1000 else int(np.argmax(reduced < -1e-9))
        if reduced[enter] >= -1e-9:
            break
        d = inverse @ full[:, enter]
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = enter
    use = np.zeros(n + m)
    use[basis] = np.maximum(x, 0)
    return use[:n], np.maximum(price, 0)


def best_plan(counts: dict[int, int], length: int = LENGTH, settings=SETTINGS) -> list[tuple[tuple[int, ...], int]]:
    """The plan of the settings that needs the fewest sequences; each takes about a second at most, whatever the counts."""
    return min((plan(counts, length, *x) for x in settings), key=lambda shapes: sum(n for _, n in shapes))


def plan(counts: dict[int, int], length: int, groups: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    """Shapes of sequences and how many have each, which hold exactly these counts of lengths.

    Full pieces stand alone. The other large lengths are rounded up within groups of equal counts, the few
    rounded lengths are packed by configurations, and each place of a group takes one of the group's own
    lengths, longest configurations first; what no configuration takes, and all small lengths, go longest
    first into the sequence that they fit best.
    """
    counts = {s: n for s, n in counts.items() if n}
    shapes = Shapes(length)
    if counts.get(length):
        shapes.add((length,), counts[length])
    large = {s: n for s, n in counts.items() if length / small < s < length}
    grouped = group_sizes(large, groups)
    merged: dict[int, dict[int, int]] = {}
    for size, _, own in grouped:
        into = merged.setdefault(size, {})
        for s, n in own.items():
            into[s] = into.get(s, 0) + n
    sizes = sorted(merged, reverse=True)
    stock = {s: sorted(merged[s].items(), reverse=True) for s in sizes}
    for pattern, n in configurations(sizes, [sum(merged[s].values()) for s in sizes], length):
        places = [s for s, c in zip(sizes, pattern, strict=True) for _ in range(c)]
        while n:  # runs of sequences whose places take the same actual lengths
            want: dict[int, int] = {}
            for s in places:
                want[s] = want.get(s, 0) + 1
            shape, run, need = [], n, {}
            for s, c in want.items():
                i, have = 0, list(stock[s])
                for _ in range(c):  # places of a sequence take the longest left, one after the other
                    while not have[i][1]:
                        i += 1
                    own = have[i][0]
                    need[s, own] = need.get((s, own), 0) + 1
                    have[i] = (own, have[i][1] - 1)
                    shape.append(own)
            for (s, own), c in need.items():
                run = min(run, dict(stock[s])[own] // c)
            run = max(run, 1)
            for (s, own), c in need.items():
                stock[s] = [(z, k - c * run if z == own else k) for z, k in stock[s] if z != own or k > c * run]
            shapes.add(tuple(sorted(shape, reverse=True)), run)
            n -= run
    rest: dict[int, int] = {}
    for s in sizes:
        for own, k in stock[s]:
            rest[own] = rest.get(own, 0) + k
    for s, n in counts.items():
        if s <= length / small:
            rest[s] = rest.get(s, 0) + n
    for s in sorted(rest, reverse=True):
        if rest[s]:
            shapes.fill(s, rest[s])
    return [(shape, n) for at in shapes.room.values() for shape, n in at.items()]


def places(shapes: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Runs of places: the items of `length` numbered from first_item on go, `each` to a sequence, to sequences from first_sequence on."""
    rows, seen, sequence = [], {}, 0
    for shape, n in sorted(shapes, reverse=True):
        offset, i = 0, 0
        while i < len(shape):
            each = 1
            while i + each < len(shape) and shape[i + each] == shape[i]:
                each += 1
            size = shape[i]
            rows.append((size, seen.get(size, 0), each * n, each, sequence, offset))
            seen[size] = seen.get(size, 0) + each * n
            offset, i = offset + each * size, i + each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first_item", "items", "each", "first_sequence", "first_offset"])


# --- on tables ----------------------------------------------------------------------------


def _numbered(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Numbers the rows of each value of the columns `by` from 0, in the order of a hash, in about sqrt(n) hash ranges.

    Only the ranges' counts are put in a line, so a hot value is spread over as many tasks as there are ranges.
    """
    ranges = max(1, math.isqrt(items.count()))
    items = items.withColumn("__h", F.xxhash64(*order)).withColumn("__r", F.pmod("__h", F.lit(ranges)))
    counts = items.groupBy(*by, "__r").agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(line), F.lit(0))).drop("__c")
    own = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__h", *order))
    return items.withColumn("__own", own).join(counts, [*by, "__r"]).withColumn("item", F.col("__before") + F.col("__own") - 1).drop("__h", "__r", "__own", "__before")


_RUNS = "length long, first_item long, items long, each long, first_sequence long, first_offset long"


def _planned(length: int):
    """The runs of places of one stretch by one setting, from its counts (at most `length` rows)."""

    def run(key, rows):
        setting = SETTINGS[key[1]]
        runs = places(best_plan(dict(zip(rows["length"].tolist(), rows["n"].tolist(), strict=True)), length, (setting,))).astype("int64")
        return runs.assign(stretch=key[0], setting=key[1])[["stretch", "setting", *(c.split()[0] for c in _RUNS.split(", "))]]

    return run


def _stretches(counts: DataFrame, length: int) -> DataFrame:
    """Runs of places of all stretches, planned on the executors; sequences are numbered from stretch to stretch."""
    counts = store(counts, "planned")
    n = counts.select("stretch").distinct().count() * len(SETTINGS)
    # an explicit number of partitions, as a plan takes seconds whatever its bytes
    each = counts.withColumn("setting", F.explode(F.array(*map(F.lit, range(len(SETTINGS))))))
    runs = each.repartition(max(1, min(n, 10_000)), "stretch", "setting").groupBy("stretch", "setting").applyInPandas(_planned(length), f"stretch long, setting int, {_RUNS}")
    runs = store(runs, "runs")
    # the setting with the fewest sequences is taken, of several the first
    used = runs.groupBy("stretch", "setting").agg(F.max(F.col("first_sequence") + F.ceil(F.col("items") / F.col("each"))).alias("n"))
    made = used.groupBy("stretch").agg(F.min(F.struct("n", "setting")).alias("best")).select("stretch", "best.n", "best.setting")
    runs = runs.join(made.select("stretch", "setting"), ["stretch", "setting"], "left_semi").drop("setting")
    line = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    base = made.select("stretch", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    return runs.join(base, "stretch").withColumn("first_sequence", F.col("first_sequence") + F.col("base")).drop("base")


def pack(items: DataFrame, order: list[str], length: int = LENGTH, stretch: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to the given one, by the plan for their counts.

    stretch: a long column whose values are packed apart and get sequences in their order.
    """
    spark = items.sparkSession
    by = [stretch, "length"] if stretch else ["length"]
    counts = items.groupBy(*by).agg(F.count("*").alias("n"))
    if stretch:
        edges = store(_stretches(counts.withColumnRenamed(stretch, "stretch"), length).withColumnRenamed("stretch", stretch), "edges")
        n, runs = items.count(), edges.count()
    else:
        held = {r["length"]: r["n"] for r in counts.collect()}  # at most `length` rows
        made = places(best_plan(held, length))
        edges = spark.createDataFrame(made.astype("int64") if len(made) else [], _RUNS)
        n, runs = sum(held.values()), len(made)
    # Each run of places covers a range of item numbers. Ranges and items meet in blocks of numbers.
    width = max(1, n // max(1, 4 * runs))
    spread = F.sequence(F.floor(F.col("first_item") / width), F.floor((F.col("first_item") + F.col("items") - 1) / width))
    edges = edges.withColumn("__block", F.explode(spread))
    numbered = _numbered(items, by, order).withColumn("__block", F.floor(F.col("item") / width))
    met = numbered.join(edges, [*by, "__block"]).where((F.col("item") >= F.col("first_item")) & (F.col("item") < F.col("first_item") + F.col("items")))
    nth = F.col("item") - F.col("first_item")
    out = met.withColumns({"sequence_id": F.col("first_sequence") + F.floor(nth / F.col("each")), "offset": F.col("first_offset") + F.pmod(nth, F.col("each")) * F.col("length")})
    return out.drop("__block", "item", "first_item", "items", "each", "first_sequence", "first_offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False, turn: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids, if asked for).

    turn: a long column, each row's own, by which documents are to be read. It is added to the result; documents are
    then packed in stretches of `stretch` turns, and sequences are numbered from stretch to stretch.

    A document is its token ids and then 0; null and empty texts are the 0 alone. Repeated rows are packed as
    often as they come; null ids are packed too; an empty table gives an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession, 4)
    kind = "doc_id long, turn long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    slim = docs.select(held_id(id_col).alias("doc_id"), (F.col(turn) if turn else F.lit(0)).cast("long").alias("turn"), F.col(text_col).alias("text"))
    items = store(slim.mapInPandas(_tokenise(length, vocabulary, with_ids), kind), "pieces")
    items = items.withColumn("__stretch", F.floor(F.col("turn") / stretch)) if turn else items.drop("turn")
    out = pack(items, ["doc_id", "piece", "ids_crc32", *(["turn"] if turn else [])], length, "__stretch" if turn else None)
    return out.drop("__stretch").withColumn("doc_id", real_id("doc_id")).withColumnsRenamed({"doc_id": id_col} | ({"turn": turn} if turn else {}))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
