"""Near-duplicate documents: a chosen-path set similarity join over five-word shingles, confirmed on full sets.

The search follows Christiani, Pagh and Sivertsen's chosen-path trees. Every document has TOKENS minwise
tokens; a node of a tree picks a few token places at random, and its documents go to a child for each
picked place and token value there, so that similar documents tend to travel together. Nodes of at most
LEAF documents are compared exhaustively; trees repeat this until a link at the threshold is found with the
probability RECALL.

Groups that are larger (copies of one page, say) are connected by pivots first: all members meet a few of them,
and only members that are still apart from the largest part of their group then meet all the others. What hangs
together is the same as if all pairs were compared, as pairs within one part need no comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Words, drop, mix64, pieces, small_batches, store, table
from quern.llm.components import components, local_labels

WIDTH, PERCENT, TOKENS, LEAF, RECALL = 5, 75, 64, 1024, 0.9999
#: Documents and shingles of a block when a large group is compared block by block; pivots of a group, and how
#: often those that are still apart get new ones.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS, TURNS = 512, 1 << 20, 4, 3
_RNG = np.random.default_rng(771)
_PLACE = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 2**32, 512, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ID = -(2**63)  # stands for a null id


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words, or all of fewer words; none without words."""
    out: list[np.ndarray] = []
    for a, b in pieces(texts):
        w = Words(texts[a:b])
        h, n = w.hash, len(w.hash)
        rolled = np.zeros(max(n - WIDTH + 1, 0), np.uint64)
        for j in range(WIDTH if n >= WIDTH else 0):
            rolled += h[j : n - WIDTH + 1 + j] * _PLACE[j]
        rolled = mix64(rolled)
        for k in range(b - a):
            i, m = w.first[k], w.count[k]
            if m >= WIDTH:
                out.append(np.unique(rolled[i : i + m - WIDTH + 1]))
            elif m:
                out.append(mix64(np.array([(h[i : i + m] * _PLACE[:m]).sum() + np.uint64(m)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray], tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minwise tokens (uint32) and two order-free fingerprints of each set; empty sets have zeros."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    sig, f = np.zeros((len(sets), tokens), np.uint32), np.zeros((2, len(sets)), np.uint64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        cuts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for j, salt in enumerate((0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D)):
            f[j, full] = np.add.reduceat(mix64(flat ^ np.uint64(salt)), cuts)
        short = (flat >> np.uint64(32)).astype(np.uint32)
        for i in range(tokens):
            v = short ^ _XOR[i]
            v *= _MUL[i]
            sig[full, i] = np.minimum.reduceat(v, cuts)
    return sig, f[0].view(np.int64), f[1].view(np.int64)


def _describe(tokens: int):
    def run(batches):
        for x in batches:
            texts = x["text"].tolist()
            for a, b in pieces(texts, 4 << 20):
                sets = shingle_sets(texts[a:b])
                sig, f1, f2 = _signatures(sets, tokens)
                yield pd.DataFrame({"real": x["real"].to_numpy()[a:b], "id": x["id"].to_numpy()[a:b], "n_shingles": [len(s) for s in sets], "f1": f1, "f2": f2, "sig": [r.tobytes() for r in sig]})

    return run


def reached(depth: int, threshold: float, agreement: float | None = None) -> float:
    """The probability that two documents share a node at a depth of a tree, by the share of tokens they agree in."""
    one, p, same = 1 - (1 / threshold - 1), 1.0, threshold if agreement is None else agreement
    for _ in range(depth):
        apart = 1 - same * p
        p = 1 - (one * apart + (1 - one) * apart * apart)
    return p


def least_agreement(threshold: float, tokens: int) -> int:
    """Tokens in which documents have to agree to be compared on full sets: four deviations below those expected."""
    return max(1, math.floor(tokens * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / tokens))))


def recall_of(trees: int, threshold: float, depth: int, tokens: int = TOKENS) -> float:
    """The probability that a link at the threshold is found: all trees read the same tokens, so the mean is taken
    over the number of tokens in which the two documents agree; too few of them are not compared."""
    chance = lambda k: math.comb(tokens, k) * threshold**k * (1 - threshold) ** (tokens - k)
    return sum(chance(k) * (1 - (1 - reached(depth, threshold, k / tokens)) ** trees) for k in range(least_agreement(threshold, tokens), tokens + 1))


def trees_for(recall: float, threshold: float, depth: int, tokens: int = TOKENS) -> int:
    """The fewest trees with this recall, or those beyond which 40 more would not add a tenth of what is missing."""
    n = 1
    while recall_of(n, threshold, depth, tokens) < recall and 1 - recall_of(n, threshold, depth, tokens) > 1.1 * (1 - recall_of(n + 40, threshold, depth, tokens)):
        n += 1
    return n


def depth_for(n: int, leaf: int) -> int:
    """Levels of a tree over n documents: its nodes shrink about 20-fold a level but for similar documents."""
    return max(3, math.ceil(math.log(max(1, n / leaf), 20)))


def _branch(node: np.ndarray, sig: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of (node, tokens) rows: row numbers and child nodes.

    A node picks one place, or two with the probability 1 / threshold - 1, by hashes of its name: all its
    documents pick alike, and 1 / threshold places are picked on average.
    """
    h = mix64(node ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    tokens = np.uint64(sig.shape[1])
    first = ((h >> np.uint64(8)) % tokens).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(32)) % (tokens - np.uint64(1))).astype(np.int64)) % int(tokens)
    two = (h & np.uint64(255)) < np.uint64(round(256 * (1 / threshold - 1)))
    rows = np.concatenate([np.arange(len(node)), np.flatnonzero(two)])
    place = np.concatenate([first, second[two]])
    child = mix64(node[rows] * np.uint64(0xD1342543DE82EF95) + (place.astype(np.uint64) << np.uint64(40)) + sig[rows, place])
    return rows, child


def _children(level: int, trees: int, threshold: float, tokens: int):
    def run(batches):
        for x in batches:
            if not len(x):
                continue
            sig = np.frombuffer(b"".join(x["sig"]), np.uint32).reshape(-1, tokens)
            ids = x["id"].to_numpy()
            starts = [x["node"].to_numpy().view(np.uint64)] if level > 1 else [np.full(len(x), mix64(np.array([t + 1], np.uint64))[0]) for t in range(trees)]
            for node in starts:
                rows, child = _branch(node, sig, level, threshold)
                yield pd.DataFrame({"node": child.view(np.int64), "id": ids[rows]})

    return run


def _runs(batches, by: list[str]):
    """Batches cut so that no run of equal `by` values is split; rows come sorted by them."""
    rest = None
    for x in batches:
        if not len(x):
            continue
        x = x if rest is None else pd.concat([rest, x], ignore_index=True)
        last = np.ones(len(x), bool)
        for c in by:
            last &= (x[c] == x[c].iloc[-1]).to_numpy()
        at = len(x) - int(last.sum())
        if at:
            yield x.iloc[:at]
        rest = x.iloc[at:]
    if rest is not None and len(rest):
        yield rest


def _leaves(tokens: int, least: int):
    """Compares the tokens of all pairs of each run, and links each document to the least one it hangs together with."""

    def run(batches):
        for x in _runs(batches, ["node", "i", "j"]):
            sig = np.frombuffer(b"".join(x["data"]), np.uint32).reshape(-1, tokens)
            ids, label = x["id"].to_numpy(), np.arange(len(x))
            key = x[["node", "i", "j"]].to_numpy()
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(1))])
            for d in range(1, len(x)):
                i = np.flatnonzero(group[d:] == group[:-d])
                if not len(i):
                    break
                i = i[label[i] != label[i + d]]  # what hangs together already needs no comparison
                for at in range(0, len(i), 1 << 14):
                    k = i[at : at + (1 << 14)]
                    k = k[(sig[k] == sig[k + d]).sum(1) >= least]
                    if len(k):
                        label = local_labels(len(x), label[k], label[k + d])[label]
            far = label != np.arange(len(x))
            yield pd.DataFrame({"u": ids[far], "v": ids[label[far]]})

    return run


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets with 100 * intersection >= percent * union, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    columns = int(column[-1]) + 1 if len(column) else 0
    step = max(1, min(columns, (1 << 21) // len(sets)))
    for at in range(0, columns, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        both += m @ m.T
    hit = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return np.nonzero(np.triu(hit, 1))


def _confirm(percent: int):
    def run(batches):
        for x in _runs(batches, ["node", "i", "j"]):
            key = x[["node", "i", "j"]].to_numpy()
            ids, raw = x["id"].to_numpy(), x["data"].tolist()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(x)]
            u, v = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 1:
                    a, b = linked([np.frombuffer(r, np.uint64) for r in raw[lo:hi]], percent)
                    label = local_labels(hi - lo, a, b)
                    far = np.flatnonzero(label != np.arange(hi - lo))
                    u.append(ids[lo + far])
                    v.append(ids[lo + label[far]])
            none = [np.zeros(0, np.int64)]
            yield pd.DataFrame({"u": np.concatenate(u or none), "v": np.concatenate(v or none)})

    return run


def _sets(batches):
    for x in batches:
        texts = x["text"].tolist()
        for a, b in pieces(texts, 4 << 20):
            yield pd.DataFrame({"id": x["id"].to_numpy()[a:b], "data": [s.tobytes() for s in shingle_sets(texts[a:b])]})


def _agree(tokens: int, least: int):
    """Which pivots' tokens agree enough with a document's."""

    def test(own: bytes, pivots: list[bytes]) -> np.ndarray:
        sig = np.frombuffer(own, np.uint32)
        return (np.frombuffer(b"".join(pivots), np.uint32).reshape(-1, tokens) == sig).sum(1) >= least

    return test


def _near(percent: int):
    """Which pivots' sets are near a document's."""

    def test(own: bytes, pivots: list[bytes]) -> np.ndarray:
        a, out = np.frombuffer(own, np.uint64), []
        for p in pivots:
            b = np.frombuffer(p, np.uint64)
            at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
            both = int((b[at] == a).sum()) if len(b) else 0
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return np.array(out)

    return test


def _meet(test):
    """A link of each document with the first of its group's pivots that the test takes; pivots that a document links
    are linked with each other once a batch, which says as much."""

    def run(batches):
        for x in batches:
            out: dict[tuple, None] = {}
            for node, i, own, pivots in zip(x["node"], x["id"], x["data"], x["pivots"], strict=True):
                hit = [int(pivots[p]["id"]) for p in np.flatnonzero(test(own, [p["data"] for p in pivots]))]
                if hit:
                    out[node, i, hit[0]] = None
                    out |= {(node, v, hit[0]): None for v in hit[1:]}
            rows = [r for r in out if r[1] != r[2]]
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 3), columns=["node", "u", "v"])

    return run


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(17)), F.col(blocks))


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))


def connect(groups: DataFrame, payload: DataFrame, compare, test) -> DataFrame:
    """Links (u, v) by which the members of each group hang together as they would by all their links.

    groups: node, id, blocks (1: the group is compared in one task); payload: id, data. compare takes runs of (node,
    i, j, id, data) and gives links by which all of a run hangs together; test(data, pivots' data) says which pivots
    a document is linked with. Rows of groups of several blocks are moved a fixed number of times while pivots
    connect them, and once for each block of those that stay apart.
    """
    kind, zero = "u long, v long", F.lit(0).cast("long")
    one = groups.where("blocks = 1").select("node", zero.alias("i"), zero.alias("j"), "id")
    few = one.count() <= 250_000  # 32 bytes a row: the broadcast is at most 8 MB
    links = [store(_by_group(payload.join(F.broadcast(one) if few else one, "id")).mapInPandas(compare, kind), "links")]
    large = store(groups.where("blocks > 1").select("node", "id", "blocks"), "large")
    if large.isEmpty():
        drop(large)
        return links[0]
    made: list[DataFrame] = []
    data = store(payload.join(large.select("id").distinct(), "id", "left_semi"), "payload")
    sizes = store(large.groupBy("node").agg(F.count("*").alias("size")), "sizes")
    rest, n = large, large.count()
    for turn in range(TURNS):
        many = rest.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_DOCS)
        # of those apart, a few by hash for each group
        h = F.xxhash64("node", "id", F.lit(turn))
        chosen = rest.join(many.select("node"), "node").groupBy("node", F.pmod(h, F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct(h.alias("h"), "id")).alias("p"))
        pivots = chosen.select("node", F.col("p.id").alias("id")).join(data, "id")
        pivots = store(pivots.groupBy("node").agg(F.collect_list(F.struct("id", "data")).alias("pivots")), "pivots")  # PIVOTS at most
        weight = pivots.select(F.sum(F.aggregate("pivots", F.lit(0).cast("long"), lambda t, x: t + F.length(x["data"])))).first()[0]
        if weight is None:
            break
        each = large.join(data, "id").join(F.broadcast(pivots) if weight <= 64 << 20 else pivots, "node")
        star = store(each.select("node", "id", "data", "pivots").mapInPandas(_meet(test), "node long, u long, v long"), "star")
        links.append(star.select("u", "v"))
        made.append(star)
        old, before = rest, n
        rest = store(_apart(rest, star, pivots.select("node", F.explode("pivots.id").alias("v")), turn), "rest")
        n = rest.count()
        drop(pivots, *([old] if old is not large else []))
        if n > before / 2:  # no part is large here: more pivots would not help
            break
    # those still apart meet all of their group, block by block
    left = rest.groupBy("node").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).join(sizes, "node")
    left = store(left.select("node", F.ceil(F.col("n") * F.col("blocks") / F.col("size")).cast("long").alias("parts")), "left")
    some = rest.select("node", "id", "blocks").join(left, "node").withColumn("i", _block("parts")).withColumn("j", _every("blocks"))
    all_ = large.join(left, "node").withColumn("j", _block("blocks")).withColumn("i", _every("parts"))
    met = some.select("node", "i", "j", "id").unionByName(all_.select("node", "i", "j", "id")).distinct()
    links.append(store(_by_group(met.join(data, "id")).mapInPandas(compare, kind), "links"))
    out = store(_union(links), "links")
    drop(data, sizes, left, large, *([rest] if rest is not large else []), *made, *links)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _apart(rest: DataFrame, star: DataFrame, pivots: DataFrame, turn: int) -> DataFrame:
    """What of `rest` (node, id, blocks) stays apart from the largest part of its group after a turn.

    That part begins as the pivot with the most links and the pivots linked with it; later pivots join it if they
    are linked with a member that is no longer apart. All members linked with its pivots belong to it.
    """
    if turn == 0:
        best = star.groupBy("node", "v").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "v"))["v"].alias("v"))
        among = star.join(best, ["node", "v"]).select("node", F.col("u").alias("v")).unionByName(best)
    else:
        among = star.join(rest.select("node", F.col("id").alias("u")), ["node", "u"], "left_anti").select("node", "v")
    core = pivots.join(among.distinct(), ["node", "v"], "left_semi")
    settled = star.join(core, ["node", "v"]).select("node", F.col("u").alias("id")).unionByName(core.withColumnRenamed("v", "id")).distinct()
    return rest.join(settled, ["node", "id"], "left_anti")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's name: a hash of its id and its text, either of which may be null."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(_ID)), F.col(text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, tokens: int = TOKENS, leaf: int = LEAF, depth: int | None = None, recall: float = RECALL, key_col: str | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable by links), kept (whether that is its own), head.

    head: whether the row is the one that stands for its group, which tells rows of one id with different texts apart.

    Null and wordless texts have the empty set and link with nothing. Documents with equal sets link (their
    similarity is 1) and travel as one; rows equal in id and text count as one document, rows of one id (or of
    none) with different texts as several. A null id is below all others. key_col: a column to add with each
    document's `row_key`. An empty table gives an empty table; columns other than the two named are not read.
    """
    small_batches(docs.sparkSession)
    threshold = percent / 100
    least = least_agreement(threshold, tokens)
    slim = docs.select(F.coalesce(F.col(id_col), F.lit(_ID)).cast("long").alias("real"), row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    all_docs = store(slim.mapInPandas(_describe(tokens), "real long, id long, n_shingles long, f1 long, f2 long, sig binary"), "sets")
    full = all_docs.where("n_shingles > 0")
    depth = depth or depth_for(all_docs.count(), leaf)
    trees = trees_for(recall, threshold, depth, tokens)
    classes = full.groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("real", "id")).alias("head"))
    classes = store(classes.withColumn("rep", F.col("head.id")), "classes")
    sigs = store(full.join(classes.select(F.col("rep").alias("id"), "n_shingles", "f1", "f2"), ["id", "n_shingles", "f1", "f2"], "left_semi").select("id", "n_shingles", "sig").dropDuplicates(["id", "n_shingles"]), "reps")

    made, leaves, rows = [], [], sigs.select("id", "sig")
    for level in range(1, depth + 1):
        kids = store(rows.mapInPandas(_children(level, trees, threshold, tokens), "node long, id long"), "nodes")
        # a table of its own, so that the join of a node with a large share of all rows can be split
        sizes = store(kids.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        kids2 = store(kids.join(sizes, "node"), "nodes")
        drop(kids, sizes)
        made.append(kids2)
        large = F.col("size") > leaf
        leaves.append(kids2 if level == depth else kids2.where(~large))
        grow = kids2.where(large)
        if level == depth or grow.isEmpty():
            break
        rows = grow.select("node", "id").join(sigs.select("id", "sig"), "id")
    groups = _union(leaves).withColumn("blocks", F.ceil(F.col("size") / leaf).cast("long"))
    found = connect(groups, sigs.select("id", F.col("sig").alias("data")), _leaves(tokens, least), _agree(tokens, least))
    drop(*made)

    near = components(found).select(F.col("node").alias("id"), F.col("label").alias("node"))
    near = store(near.join(sigs.select("id", "n_shingles"), "id"), "near")
    blocks = near.groupBy("node").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    blocks = store(blocks, "blocks")
    members = store(near.join(blocks, "node").select("id", "node", F.col("blocks").cast("long").alias("blocks")), "members")
    drop(blocks)
    few = members.count() <= 1_000_000  # 8 bytes a row: the broadcast is at most 8 MB
    ids = members.select("id")
    texts = slim.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text")
    # rows equal in id and text come once
    again = store(all_docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if not again.isEmpty():
        texts = texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id", "left_semi").dropDuplicates(["id"]))
    edges = connect(members, texts.mapInPandas(_sets, "id long, data binary"), _confirm(percent), _near(percent))
    labels = components(edges)
    labels = store(classes.join(labels, classes.rep == labels.node, "left").drop("node", "rep"), "labelled")
    # keys have no order of their own: a component is named by its least id
    heads = labels.where("label is not null").groupBy("label").agg(F.min("head").alias("least"))
    labels = store(labels.join(heads, "label", "left").select("n_shingles", "f1", "f2", F.coalesce("least", "head").alias("component")), "labels")
    drop(found, near, members, again, edges, sigs, classes)

    out = all_docs.join(labels, ["n_shingles", "f1", "f2"], "left")
    real = lambda c: F.nullif(c, F.lit(_ID))
    head = F.coalesce(F.col("id") == F.col("component.id"), F.lit(True))
    component = F.coalesce("component.real", "real")
    key = [F.col("id").alias(key_col)] if key_col else []
    return out.select(real(F.col("real")).alias(id_col), "n_shingles", real(component).alias("component_id"), (F.col("real") == component).alias("kept"), head.alias("head"), *key)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("head")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
f AS (SELECT x, list(doc_id) AS ds FROM e GROUP BY x HAVING count(*) > 1),
p AS (SELECT a, b, count(*) AS n FROM (SELECT a, unnest(ds) AS b FROM (SELECT ds, unnest(ds) AS a FROM f)) WHERE a < b GROUP BY a, b),
l AS (SELECT a, b FROM p JOIN s AS sa ON sa.doc_id = a JOIN s AS sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.sh) + len(sb.sh) - n)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON a = doc_id
"""
