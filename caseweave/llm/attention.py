"""A small causal self-attention language model in numpy.

One attention head reads the last inputs and gates a mixture of experts; every
expert is a table of next-class probabilities per input, so a mixture of
bigram models follows the context (its language, its style).  Only the target's
probability is ever looked up in a table, which keeps scoring cheap.

Outputs are classes: frequent subwords have a class each, rarer ones share
classes of about equal weight and are told apart by their corpus frequency
inside the class.  Inputs are frequent subwords and, for the rest, their class.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DIM, EXPERTS = 8, 6
CLASSES, SHARED = 512, 32
INPUTS = 512
PRIOR = 20.0  # pseudo-counts that draw a table row to what it is built on
CONTEXT = 32  # keys of a window; the second half of a window is scored, the first half is context
STRIDE = CONTEXT // 2
WINDOWS = 32  # of a training step


class Coding(NamedTuple):
    """How subword ids map to input rows and output classes."""

    row: np.ndarray
    cls: np.ndarray
    within: np.ndarray  # natural log of the id's share of its class
    rows: int


def coding(counts: np.ndarray, smooth: float = 0.1) -> Coding:
    """Classes and inputs by the corpus count of every subword id."""
    order = np.argsort(-counts, kind="stable")
    own = CLASSES - SHARED
    cls, row = np.zeros(len(counts), np.int32), np.zeros(len(counts), np.int32)
    cls[order[:own]] = np.arange(own)
    tail = order[own:]
    mass = np.cumsum(counts[tail] + smooth)
    cls[tail] = own + np.minimum((mass - 1e-9) / mass[-1] * SHARED, SHARED - 1).astype(np.int32)
    row[order[:INPUTS]] = np.arange(INPUTS)
    row[order[INPUTS:]] = INPUTS + cls[order[INPUTS:]] - own
    total = np.bincount(cls, counts + smooth, CLASSES)
    return Coding(row, cls, np.log((counts + smooth) / total[cls]), INPUTS + SHARED)


Weights = dict[str, np.ndarray]


def bigram_table(class_counts: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """Next-class probabilities per input, drawn to the class frequencies where an input is rare."""
    base = (class_counts + 0.5) / (class_counts + 0.5).sum()
    return (bigrams + PRIOR * base) / (bigrams.sum(axis=1, keepdims=True) + PRIOR)


def initial(code: Coding, bigram: np.ndarray, seed: int = 1) -> tuple[Weights, np.ndarray]:
    """Random gate weights, and expert tables near the bigram table."""
    rng = np.random.default_rng(seed)
    start = {"q": rng.normal(0, 0.3, (code.rows, DIM)), "k": rng.normal(0, 0.3, (code.rows, DIM)),
             "v": rng.normal(0, 1.0, (code.rows, DIM)), "g": rng.normal(0, 1.0, (DIM, EXPERTS)),
             "o": np.zeros(EXPERTS), "d": np.zeros(CONTEXT)}
    noisy = bigram[:, :, None] * np.exp(rng.normal(0, 0.3, (*bigram.shape, EXPERTS)))
    return {n: w.astype(np.float32) for n, w in start.items()}, (noisy / noisy.sum(axis=1, keepdims=True)).astype(np.float32)


def expert_tables(counts: np.ndarray, bigram: np.ndarray) -> np.ndarray:
    """Experts from the transitions they are responsible for, drawn to the bigram table."""
    table = (counts + PRIOR * bigram[:, :, None]) / (counts.sum(axis=1, keepdims=True) + PRIOR)
    return table.astype(np.float32)


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in sorted(weights)])


def unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at: at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def _position_factor(d: np.ndarray, queries: int, keys: int) -> np.ndarray:
    """Factor by distance, 0 for the future; the last query sits on the last key."""
    distance = np.arange(keys - queries, keys)[:, None] - np.arange(keys)[None, :]
    return np.where(distance >= 0, np.exp(d[np.clip(distance, 0, CONTEXT - 1)]), 0).astype(np.float32)


def attend(weights: Weights, x: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention weights and outputs of the last places of each window of inputs ``x``, one per row of ``factor``."""
    take = np.take
    q = take(weights["q"] * np.float32(DIM ** -0.5), x[:, -len(factor):], axis=0, mode="clip")
    share = q @ take(weights["k"], x, axis=0, mode="clip").transpose(0, 2, 1)
    np.clip(share, -30, 30, out=share)
    np.exp(share, out=share)
    share *= factor
    share /= share.sum(axis=2, keepdims=True)
    return share, share @ take(weights["v"], x, axis=0, mode="clip")


def gate(weights: Weights, out: np.ndarray) -> np.ndarray:
    """Weights of the experts, one row per place."""
    u = out.reshape(-1, DIM) @ weights["g"] + weights["o"]
    u -= u.max(axis=1, keepdims=True)
    np.exp(u, out=u)
    u /= u.sum(axis=1, keepdims=True)
    return u


class Scorer:
    """Log probabilities of whole documents."""

    def __init__(self, weights: Weights, table: np.ndarray, code: Coding, end: int, windows: int = 256,
                 begins: np.ndarray | None = None):
        """``begins``: which ids begin a word or end a text (default: all)."""
        self.weights, self.code, self.end, self.windows = weights, code, end, windows
        self.table = table.reshape(-1, EXPERTS)
        share = np.bincount(code.cls, np.exp(code.within) * (1.0 if begins is None else begins), CLASSES)
        self.begin_table = np.einsum("rce,c->re", table.astype(np.float32), share.astype(np.float32))

    def _windows(self, x: np.ndarray, y: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of classes ``y`` at the last places of windows ``x``, and of a word's beginning there."""
        _, out = attend(self.weights, x, factor)
        last, pi = x[:, -len(factor):], gate(self.weights, out)
        said = np.take(self.table, (last * CLASSES + y).ravel(), axis=0, mode="clip")
        begun = np.take(self.begin_table, last.ravel(), axis=0, mode="clip")
        return np.einsum("ne,ne->n", said, pi), np.einsum("ne,ne->n", begun, pi)

    def score(self, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of every token, and of a word's beginning at its place.

        ``tokens`` holds ``count[d]`` ids of each document.
        """
        result = np.zeros((2, len(tokens) + STRIDE))

        def put(place: np.ndarray, valid: np.ndarray, said: np.ndarray, begun: np.ndarray) -> None:
            for row, p in zip(result, (said, begun)):
                row[place[valid]] = np.log(p).reshape(place.shape)[valid]

        self._each(tokens, count, put)
        return result[0, : len(tokens)] + self.code.within[tokens], result[1, : len(tokens)]

    def _each(self, tokens: np.ndarray, count: np.ndarray, use) -> None:
        """Call ``use(place, valid, said, begun)`` on windows that hold every token once.

        A window has 32 inputs and scores its last 16; windows overlap by half,
        so every token is scored once with 16 to 31 tokens before it.  The first
        window of a document has no context half.
        """
        stop = np.cumsum(count)
        start, some = stop - count, count > 0
        inputs = np.empty(len(tokens), np.int64)
        inputs[1:] = tokens[:-1]
        inputs[start[some]] = self.end
        pad = np.zeros(STRIDE, np.int64)
        x = np.concatenate([self.code.row[inputs], pad])
        y = np.concatenate([self.code.cls[tokens], pad])

        def run(begin: np.ndarray, last: np.ndarray, keys: int) -> None:
            factor = _position_factor(self.weights["d"], STRIDE, keys)
            for lo in range(0, len(begin), self.windows):
                at = begin[lo: lo + self.windows, None]
                place = at + np.arange(STRIDE)
                valid = place < last[lo: lo + self.windows, None]
                use(place, valid, *self._windows(x[at + np.arange(STRIDE - keys, STRIDE)], y[place], factor))

        run(start[some], stop[some], STRIDE)
        more = np.maximum(-(-count // STRIDE) - 1, 0)
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        run(np.repeat(start, more) + (nth + 1) * STRIDE, np.repeat(stop, more), CONTEXT)


def _rows_sum(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sum of value rows by index."""
    return np.stack([np.bincount(index, values[:, j], rows) for j in range(values.shape[1])], axis=1).astype(np.float32)


def gradients(weights: Weights, table: np.ndarray, x: np.ndarray, y: np.ndarray,
              valid: np.ndarray) -> tuple[float, Weights, np.ndarray]:
    """Mean loss over the valid places of windows ``x`` with targets ``y``, the gate's gradients, and how
    responsible each expert is for each place."""
    n, length = x.shape
    rows = weights["q"].shape[0]
    factor = _position_factor(weights["d"], length, length)
    share, out = attend(weights, x, factor)
    pi, flat = gate(weights, out), x.ravel()
    joint = pi * table[flat, y.ravel()]
    p = joint.sum(axis=1, keepdims=True)
    use = valid.ravel().astype(np.float32)[:, None]
    total = max(float(use.sum()), 1.0)
    loss = float(-(np.log(p) * use).sum() / total)
    mine = joint / p * use
    d_u = (pi * use - mine) / np.float32(total)
    d_out = (d_u @ weights["g"].T).reshape(n, length, DIM)
    q, k, v = (weights[m][x] for m in "qkv")
    d_share = d_out @ v.transpose(0, 2, 1)
    d_score = share * (d_share - (share * d_share).sum(axis=2, keepdims=True))
    by_place = d_score.sum(axis=0)
    distance = np.arange(length)[:, None] - np.arange(length)[None, :]
    causal = distance >= 0
    scale = np.float32(DIM ** -0.5)
    grads = {"g": out.reshape(-1, DIM).T @ d_u, "o": d_u.sum(axis=0),
             "d": np.bincount(distance[causal], by_place[causal], CONTEXT).astype(np.float32),
             "q": _rows_sum(flat, (d_score @ k).reshape(-1, DIM) * scale, rows),
             "k": _rows_sum(flat, (d_score.transpose(0, 2, 1) @ q).reshape(-1, DIM) * scale, rows),
             "v": _rows_sum(flat, (share.transpose(0, 2, 1) @ d_out).reshape(-1, DIM), rows)}
    return loss, grads, mine


class Trainer:
    """One round over a share of the sequences.

    The gate takes Adam steps; the transitions each expert is responsible for
    are counted, so the tables of the next round follow in closed form.
    """

    def __init__(self, weights: Weights, table: np.ndarray, code: Coding, rate: float):
        self.weights = {n: w.copy() for n, w in weights.items()}
        self.table, self.code, self.rate, self.steps, self.seen = table, code, rate, 0, 0
        self.counts = np.zeros((table.shape[0] * table.shape[1], EXPERTS))
        self.mean = {n: np.zeros_like(w) for n, w in weights.items()}
        self.square = {n: np.zeros_like(w) for n, w in weights.items()}

    def learn(self, sequences: list[np.ndarray]) -> float:
        """Steps over id sequences, the first id of each an input only; the mean loss."""
        ids = np.concatenate(sequences)
        row, cls = self.code.row[ids].astype(np.int64), self.code.cls[ids].astype(np.int64)
        length = np.array([len(s) for s in sequences])
        stop = np.cumsum(length)
        each = np.maximum(-(-(length - 1) // CONTEXT), 0)
        begin = np.repeat(stop - length - CONTEXT * (np.cumsum(each) - each), each) + CONTEXT * np.arange(each.sum())
        last = np.repeat(stop - 1, each)  # no input
        cells, shares, lost = [], [], 0.0
        for lo in range(0, len(begin), WINDOWS):
            place = begin[lo: lo + WINDOWS, None] + np.arange(CONTEXT)
            valid = place < last[lo: lo + WINDOWS, None]
            place = np.where(valid, place, 0)
            x, y = np.where(valid, row[place], 0), np.where(valid, cls[np.minimum(place + 1, len(cls) - 1)], 0)
            loss, grads, mine = gradients(self.weights, self.table, x, y, valid)
            cells.append((x * CLASSES + y).ravel())
            shares.append(mine)
            lost += loss * valid.sum()
            self._descend(grads)
        if cells:
            cell, share = np.concatenate(cells), np.concatenate(shares)
            for j in range(EXPERTS):
                self.counts[:, j] += np.bincount(cell, share[:, j], len(self.counts))
        count = int((length - 1).clip(0).sum())
        self.seen += count
        return lost / max(count, 1)

    def _descend(self, grads: Weights) -> None:
        """One Adam step."""
        self.steps += 1
        for n, g in grads.items():
            self.mean[n] += 0.1 * (g - self.mean[n])
            self.square[n] += 0.02 * (g * g - self.square[n])
            up = self.mean[n] / (1 - 0.9 ** self.steps)
            self.weights[n] -= self.rate * up / (np.sqrt(self.square[n] / (1 - 0.98 ** self.steps)) + 1e-6)
