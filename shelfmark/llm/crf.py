"""A linear-chain conditional random field over binary features, trained by gradient ascent on the
conditional log-likelihood and decoded by Viterbi, a batch of sequences at a time."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np


def _padded(lengths: np.ndarray, flat: np.ndarray, labels: int) -> np.ndarray:
    out = np.zeros((len(lengths), int(lengths.max(initial=0)), labels))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Crf:
    """Weights by feature, a row of one weight per label; transitions from row to column."""

    weights: dict[str, np.ndarray]
    transitions: np.ndarray
    start: np.ndarray

    @property
    def labels(self) -> int:
        return len(self.start)

    def emissions(self, items: list[list[str]]) -> np.ndarray:
        """A row of label scores for each item's features; unknown features count nothing."""
        get, none = self.weights.get, np.zeros(self.labels)
        n = np.fromiter(map(len, items), np.int64, len(items))
        out = np.zeros((len(items), self.labels))
        if n.any():
            # each item is added up by itself, so its score doesn't depend on what stands around it
            rows = np.array([get(f, none) for f in chain.from_iterable(items)])
            out[n > 0] = np.add.reduceat(rows, (np.cumsum(n) - n)[n > 0])
        return out

    def viterbi(self, lengths: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        """The best labels of consecutive sequences of these lengths, as one array. Sequences are dealt
        with in groups of like length, so one very long sequence doesn't pad the others."""
        out = np.zeros(len(emissions), np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for s in np.unique(size[lengths > 0]):
            which = np.flatnonzero((size == s) & (lengths > 0))
            for part in np.array_split(which, max(1, len(which) * (1 << int(s)) // 2_000_000)):
                n = lengths[part]
                at = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                em = _padded(n, emissions[at], self.labels)
                best, back = em[:, 0] + self.start, np.zeros(em.shape, np.int8)
                ends = np.zeros((len(part), self.labels))
                ends[n == 1] = best[n == 1]
                for t in range(1, em.shape[1]):
                    step = best[:, :, None] + self.transitions[None]
                    back[:, t] = step.argmax(1)
                    best = step.max(1) + em[:, t]
                    ends[n == t + 1] = best[n == t + 1]
                label, path = ends.argmax(1), np.zeros(em.shape[:2], np.int64)
                rows = np.arange(len(part))
                for t in range(em.shape[1] - 1, -1, -1):
                    inside = t < n
                    path[:, t] = np.where(inside, label, 0)
                    if t:
                        label = np.where(inside, back[rows, t, label], label)
                out[at] = path[np.arange(em.shape[1])[None, :] < n[:, None]]
        return out

    def decode(self, sequences: list[list[list[str]]]) -> list[list[int]]:
        n = np.fromiter(map(len, sequences), np.int64, len(sequences))
        got = self.viterbi(n, self.emissions(list(chain.from_iterable(sequences)))).tolist()
        edges = np.concatenate([[0], np.cumsum(n)]).tolist()
        return [got[a:b] for a, b in zip(edges, edges[1:])]


def train(sequences: list[list[list[str]]], gold: list[list[int]], labels: int = 2, l2: float = 0.5, rounds: int = 120, rate: float = 0.3) -> Crf:
    """Fits on labelled sequences of feature lists; deterministic. Full-batch gradients from
    forward-backward, per-coordinate rates (Adagrad), Gaussian prior of precision l2."""
    index: dict[str, int] = {}
    for seq in sequences:
        for item in seq:
            for f in item:
                index.setdefault(f, len(index))
    items = [i for s in sequences for i in s]
    n_feat = np.fromiter(map(len, items), np.int64, len(items))
    feat = np.fromiter((index[f] for i in items for f in i), np.int64, int(n_feat.sum()))
    owner = np.repeat(np.arange(len(items)), n_feat)
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    y = np.array([v for g in gold for v in g])
    mask = np.arange(lengths.max())[None, :] < lengths[:, None]
    one = np.zeros((len(y), labels))
    one[np.arange(len(y)), y] = 1
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    inner = np.setdiff1d(np.arange(len(y)), first)
    true_pairs = np.zeros((labels, labels))
    np.add.at(true_pairs, (y[inner - 1], y[inner]), 1)
    w, trans, start = np.zeros((len(index), labels)), np.zeros((labels, labels)), np.zeros(labels)
    seen = [np.full_like(p, 1e-8) for p in (w, trans, start)]
    rows = np.arange(len(lengths))
    for _ in range(rounds):
        em = np.zeros((len(items), labels))
        np.add.at(em, owner, w[feat])
        e = _padded(lengths, em, labels)
        span = e.shape[1]
        fwd, bwd = np.zeros(e.shape), np.zeros(e.shape)
        fwd[:, 0] = e[:, 0] + start
        for t in range(1, span):
            fwd[:, t] = _lse(fwd[:, t - 1][:, :, None] + trans[None], 1) + e[:, t]
        for t in range(span - 2, -1, -1):
            ahead = _lse(trans[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where((t + 1 < lengths)[:, None], ahead, 0)
        z = _lse(fwd[rows, lengths - 1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])[mask]
        pairs = np.zeros((labels, labels))
        for t in range(1, span):
            live = t < lengths
            x = fwd[live, t - 1][:, :, None] + trans[None] + (e[live, t] + bwd[live, t])[:, None, :] - z[live][:, None, None]
            pairs += np.exp(x).sum(0)
        g = (one - p)[owner]
        gw = np.zeros_like(w)
        np.add.at(gw, feat, g)
        grads = (gw - l2 * w, true_pairs - pairs - l2 * trans, (one - p)[first].sum(0) - l2 * start)
        for param, grad, s in zip((w, trans, start), grads, seen, strict=True):
            s += grad**2
            param += rate * grad / np.sqrt(s)
    return Crf({f: w[i] for f, i in index.items()}, trans, start)
