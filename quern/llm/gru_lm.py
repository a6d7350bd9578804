"""A gated recurrent language model with class-factored outputs, in numpy."""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Most frequent words with an output each, words of a head class, and classes of all other words.
HEAD, CLASS, TAIL = 2048, 64, 24
HEAD_CLASSES = HEAD // CLASS
CLASSES, INPUTS = HEAD_CLASSES + TAIL + 1, HEAD + TAIL + 1
END = INPUTS - 1
EMBED, HIDDEN, SPAN = 16, 16, 24
#: Tokens that scoring reads at a time: a span is the longer the fewer documents are left in a batch.
PACE = 6144
SHAPES = {
    "emb": (INPUTS, EMBED), "wi": (EMBED, 3 * HIDDEN), "bi": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
    "ww": (HEAD_CLASSES, CLASS, HIDDEN), "bw": (HEAD_CLASSES, CLASS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def initial(head_counts: np.ndarray, class_counts: np.ndarray) -> np.ndarray:
    """Small random weights; output biases are the logarithms of the corpus counts."""
    rng = np.random.default_rng(5)
    flat = np.zeros(SIZE, np.float32)
    p = views(flat)
    for k in ("emb", "wi", "u", "wc", "ww"):
        p[k][...] = rng.normal(0, 0.5 if k == "emb" else 1 / np.sqrt(SHAPES[k][-1] if k == "ww" else SHAPES[k][0]), SHAPES[k]) * (0.3 if k in ("wc", "ww") else 1)
    counts = np.zeros(HEAD)
    counts[: len(head_counts)] = head_counts
    p["bw"][...] = np.log(counts + 1e-3).reshape(HEAD_CLASSES, CLASS)
    p["bc"][...] = np.log(class_counts + 1e-3)
    p["bc"] -= p["bc"].max()
    p["bw"] -= p["bw"].max(1, keepdims=True)
    return flat


def classes(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // CLASS, ids - HEAD + HEAD_CLASSES)


def lanes(first: np.ndarray, most: int) -> tuple[list[list[int]], np.ndarray]:
    """Whole documents (runs first[i]..first[i + 1]) dealt to at most `most` lanes of about equal length, longest lane first."""
    sizes = np.diff(first)
    n = max(1, min(most, len(sizes)))
    heap, dealt, total = [(0, i) for i in range(n)], [[] for _ in range(n)], np.zeros(n, np.int64)
    for d in np.argsort(-sizes, kind="stable"):
        have, i = heapq.heappop(heap)
        dealt[i].append(int(d))
        total[i] = have + sizes[d]
        heapq.heappush(heap, (int(total[i]), i))
    order = np.argsort(-total, kind="stable")
    return [dealt[i] for i in order], total[order]


def grid(ids: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps x lanes of token ids (-1: over) and of document numbers, and the number of lanes alive at each step."""
    dealt, total = lanes(first, most)
    steps = int(total[0]) if len(total) else 0
    out, doc = np.full((len(dealt), steps), -1, np.int32), np.zeros((len(dealt), steps), np.int32)
    for i, ds in enumerate(dealt):
        if ds:
            out[i, : total[i]] = np.concatenate([ids[first[d] : first[d + 1]] for d in ds])
            doc[i, : total[i]] = np.repeat(ds, [first[d + 1] - first[d] for d in ds])
    alive = np.searchsorted(-total, -np.arange(steps), side="left")
    return np.ascontiguousarray(out.T), np.ascontiguousarray(doc.T), alive


#: sigmoid(v) is (tanh(v / 2) + 1) / 2: what makes both gates is halved first.
_HALF = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)


def _flip(a: np.ndarray) -> np.ndarray:
    """steps x lanes x parts laid out as steps x parts x lanes: each gate of a step is one block. Free for what is so laid out."""
    return np.ascontiguousarray(a.transpose(0, 2, 1))


def forward(p, table, ids, fresh, h, keep: bool):
    """Reads a span: ids and fresh (a document begins) are steps x lanes, h the state before it.

    Returns the state before each step, what backpropagation needs if kept (gates, new states, recurrent inputs; lanes
    last), and the state after the span.
    """
    steps, n = ids.shape
    before = np.empty((steps, HIDDEN, n), np.float32)
    x, ut, k, begins, stays = _flip(np.take(table * _HALF, ids, 0)), np.ascontiguousarray((p["u"] * _HALF).T), HIDDEN, fresh.any(1), (~fresh).astype(np.float32)
    gates, states, rec = (np.empty((steps if keep else 1, w, n), np.float32) for w in (2 * k, k, k))
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        if begins[t]:
            h = h * stays[t]
        before[t] = h
        i = t if keep else 0
        g, r, zr, new = x[t], ut @ h, gates[i], states[i]
        np.add(g[: 2 * k], r[: 2 * k], out=zr)
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        rec[i] = r[2 * k :]
        np.multiply(zr[k:], rec[i], out=new)
        new += g[2 * k :]
        np.tanh(new, out=new)
        h = before[t] - new
        h *= zr[:k]
        h += new
    return before.transpose(0, 2, 1), (gates, states, rec), h.T


def _bound(w: np.ndarray) -> float:
    """The most that a product of weights (... x HIDDEN + 1) with a state, whose parts are within -1 and 1, and 1 can be."""
    return float((np.abs(w).reshape(-1, HIDDEN + 1) @ np.ones(HIDDEN + 1, np.float32)).max())


def _softmax(w, x, y, tame: bool, real=None):
    """The tokens' log-probability, from the logits w @ x (a column for each token) and y, the place of each token's own output.

    With real (0 or 1 for each token): the gradient of the real tokens' loss by the logits instead.
    """
    e = w @ x
    if not tame:
        e -= e.max(0)
    own = y * e.shape[1] + np.arange(e.shape[1])
    right = e.ravel()[own] if real is None else None
    np.exp(e, out=e)
    total = e.sum(0)  # row by row, so that equal columns have equal sums wherever they stand
    if real is None:
        return right - np.log(total)
    e *= real / total
    e.ravel()[own] -= real
    return e


def outputs(p, before, ids, real, learn: bool):
    """Log-probabilities (natural) of the real tokens, given the states before them; with learn, the gradients instead."""
    y = ids.ravel()
    # a row of ones stands for the biases
    x = np.empty((HIDDEN + 1, len(y)), before.dtype)
    x[:HIDDEN].reshape(HIDDEN, *ids.shape)[...] = before.transpose(2, 0, 1)
    x[HIDDEN] = 1
    c = classes(y)
    wc, ww = np.concatenate([p["wc"].T, p["bc"][:, None]], 1), np.concatenate([p["ww"], p["bw"][:, :, None]], 2)
    tame = _bound(wc) < 60 and _bound(ww) < 60
    mask = real.ravel().astype(np.float32)
    e = _softmax(wc, x, c, tame, mask if learn else None)
    if learn:
        g = x @ e.T
        gw = np.zeros(ww.shape, ww.dtype)
        dx = wc[:, :HIDDEN].T @ e
    else:
        logp = e * mask
    # the tokens of head classes, class by class
    order = np.argsort(c.astype(np.int16), kind="stable")
    cut = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1))
    order = order[: cut[-1]]
    xs, ys = np.take(x, order, 1), y[order] % CLASS
    back = np.empty((HIDDEN, len(order)), x.dtype) if learn else np.empty(len(order), e.dtype)
    one = np.float32(1)
    for k in np.flatnonzero(np.diff(cut)):
        i = slice(cut[k], cut[k + 1])
        xi = xs[:, i]
        e = _softmax(ww[k], xi, ys[i], tame, one if learn else None)
        if learn:
            np.matmul(e, xi.T, out=gw[k])
            back[:, i] = p["ww"][k].T @ e
        else:
            back[i] = e
    if not learn:
        logp[order] += back
        return logp, None, None
    dx[:, order] += back
    grad = {"wc": g[:HIDDEN], "bc": g[HIDDEN], "ww": gw[:, :, :HIDDEN], "bw": gw[:, :, HIDDEN]}
    return None, grad, dx.reshape(HIDDEN, *ids.shape).transpose(1, 2, 0)


def backward(p, ids, fresh, before, gates, dbefore):
    """Truncated backpropagation through a span, from the gradients of the states before each step."""
    steps, n = ids.shape
    k = HIDDEN
    before, dbefore = _flip(before), _flip(dbefore)
    zr, new, rec = gates
    z, r = zr[:, :k], zr[:, k:]
    # what the gradient of the state is multiplied by for each part of the recurrent input, for all steps at once
    by = np.empty((steps, 3, k, n), before.dtype)
    not_z = 1 - z
    by_new = new * new
    np.subtract(1, by_new, out=by_new)
    by_new *= not_z
    not_z *= z
    np.multiply(before - new, not_z, out=by[:, 0])
    np.multiply(by_new, r, out=by[:, 2])
    np.multiply(by[:, 2], rec, out=by[:, 1])
    by[:, 1] *= 1 - r
    drec, after = np.empty((steps, 3, k, n), before.dtype), np.empty((steps, k, n), before.dtype)
    begins, stays, dh, u = fresh.any(1), (~fresh).astype(before.dtype), np.zeros((k, n), before.dtype), np.ascontiguousarray(p["u"])
    for t in range(steps - 1, -1, -1):
        after[t] = dh
        np.multiply(dh, by[t], out=drec[t])
        dh = dh * z[t]
        dh += u @ drec[t].reshape(3 * k, n)
        dh += dbefore[t]
        if begins[t]:
            dh *= stays[t]
    flat = drec.reshape(steps, 3 * k, n)
    du = (flat @ before.transpose(0, 2, 1)).sum(0).T
    np.multiply(after, by_new, out=drec[:, 2])
    x = ids.ravel()
    dwi = (flat @ p["emb"][ids]).sum(0).T
    de = (p["wi"] @ flat).transpose(1, 0, 2).reshape(EMBED, -1)
    demb = np.stack([np.bincount(x, d, INPUTS) for d in de]).T
    return {"emb": demb, "wi": dwi, "bi": (flat @ np.ones(n, flat.dtype)).sum(0), "u": du}


def spans(tokens, doc, alive, size: int = 0):
    """Spans of SPAN steps, or of about `size` tokens, over the lanes alive at their first: ids, documents, fresh (a document
    begins) and what is real.

    Lanes that are over within a span read ends, which count for nothing.
    """
    last, at = None, 0
    while at < len(tokens):
        n = int(alive[at])
        steps = max(1, size // n) if size else SPAN
        x, d = tokens[at : at + steps, :n], doc[at : at + steps, :n]
        before = np.concatenate([np.full((1, n), -1, d.dtype) if last is None else last[None, :n], d[:-1]])
        last = d[-1]
        yield np.where(x < 0, END, x), d, d != before, x >= 0
        at += steps


def train(flat: np.ndarray, ids: np.ndarray, first: np.ndarray, memory: dict, rate: float = 0.01, most: int = 128) -> int:
    """One pass over documents, changing flat; memory keeps the step sizes (Adam) from call to call. Returns the tokens read."""
    p = views(flat)
    tokens, doc, alive = grid(ids, first, most)
    if "m" not in memory:
        memory |= {"m": np.zeros(SIZE, np.float32), "v": np.zeros(SIZE, np.float32), "n": 0}
    h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
    grad = np.zeros(SIZE, np.float32)
    g = views(grad)
    for x, _, fresh, real in spans(tokens, doc, alive):
        table = p["emb"] @ p["wi"] + p["bi"]
        before, gates, h = forward(p, table, x, fresh, h[: x.shape[1]], True)
        _, go, dx = outputs(p, before, x, real, True)
        gi = backward(p, x, fresh, before, gates, dx)
        for k, v in (go | gi).items():
            g[k][...] = v
        grad /= max(1, int(real.sum()))
        norm = np.sqrt(np.dot(grad, grad))
        if norm > 1:
            grad /= norm
        memory["n"] += 1
        m, v, i = memory["m"], memory["v"], memory["n"]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        grad *= grad
        grad *= 0.01
        v += grad
        np.sqrt(v, out=grad)
        grad += 1e-8
        np.divide(m, grad, out=grad)
        grad *= rate * math.sqrt(1 - 0.99**i) / (1 - 0.9**i)
        flat -= grad
    return int(ids.size)


def score(flat: np.ndarray, ids: np.ndarray, first: np.ndarray, most: int = 256) -> np.ndarray:
    """The log10 probability of each document's classes and head words, its state carried to its end."""
    p = views(flat)
    table = p["emb"] @ p["wi"] + p["bi"]
    tokens, doc, alive = grid(ids, first, most)
    h, out = np.zeros((tokens.shape[1], HIDDEN), np.float32), np.zeros(len(first) - 1)
    for x, d, fresh, real in spans(tokens, doc, alive, PACE):
        before, _, h = forward(p, table, x, fresh, h[: x.shape[1]], False)
        logp, _, _ = outputs(p, before, x, real, False)
        out += np.bincount(d.ravel(), logp, len(out))
    return out / np.log(10)
