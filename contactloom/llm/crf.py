"""A linear-chain conditional random field over binary features, in numpy."""

from __future__ import annotations

import numpy as np


class Chain:
    """Scores of labels: emissions are sums of feature weights, transitions a matrix, with start scores."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """``features``: for each position the numbers of its active features; -1 is none."""
        weights = np.vstack([self.emit, np.zeros((1, self.emit.shape[1]))])
        return weights[features].sum(axis=1)

    def decode(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi over many sequences at once: ``scores`` of all positions, ``sizes`` of the sequences.

        Sequences are taken by falling length; step t works on those longer than t.
        """
        n_labels = self.emit.shape[1]
        out = np.zeros(len(scores), np.int8)
        sizes = np.asarray(sizes, np.int64)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return out
        n, at = sizes[order], begins[order]
        best = scores[at] + self.start
        back = np.zeros((len(scores), n_labels), np.int8)
        active = len(order)
        ends = np.zeros((len(order), n_labels))
        for t in range(int(n[0])):
            if t:
                live = int(np.searchsorted(-n, -t, side="left"))
                ends[live:active] = best[live:active]
                active = live
                paths = best[:active, :, None] + self.move
                back[at[:active] + t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + scores[at[:active] + t]
        ends[:active] = best[:active]
        label = ends.argmax(axis=1)
        for t in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            out[at[:live] + t] = label[:live]
            if t:
                label[:live] = back[at[:live] + t, label[:live]]
        return out


def train(sequences: list[tuple[np.ndarray, np.ndarray]], n_features: int, n_labels: int, rounds: int = 150, l2: float = 0.01, rate: float = 0.2) -> Chain:
    """Maximum penalised likelihood by full-batch gradient ascent with Adam steps.

    ``sequences``: (features, labels) of each. Deterministic: starts from zero
    and visits everything in order.
    """
    sequences = [(f, y) for f, y in sequences if len(y)]
    longest = max((len(y) for _, y in sequences), default=0)
    count = len(sequences)
    width = max((f.shape[1] for f, _ in sequences), default=1)
    feats = np.full((count, longest, width), n_features, np.int64)
    gold = np.zeros((count, longest), np.int64)
    mask = np.zeros((count, longest), bool)
    for i, (f, y) in enumerate(sequences):
        feats[i, : len(y)], gold[i, : len(y)], mask[i, : len(y)] = np.where(f < 0, n_features, f), y, True
    one_hot = np.eye(n_labels)
    gold_hot = one_hot[gold] * mask[..., None]
    params = [np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    both = mask[:, 1:] & mask[:, :-1]
    gold_move = np.einsum("bti,btj,bt->ij", one_hot[gold[:, :-1]], one_hot[gold[:, 1:]], both.astype(float)) if count else 0
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    for r in range(1, rounds + 1 if count else 0):
        emit, move, start = params
        scores = np.vstack([emit, np.zeros((1, n_labels))])[feats].sum(axis=2)
        fwd = np.zeros((count, longest, n_labels))
        fwd[:, 0] = scores[:, 0] + start
        for t in range(1, longest):
            step = lse(fwd[:, t - 1, :, None] + move, 1) + scores[:, t]
            fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
        bwd = np.zeros((count, longest, n_labels))
        for t in range(longest - 2, -1, -1):
            step = lse(move + (scores[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = lse(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - total[:, None, None]) * mask[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + move + (scores[:, 1:] + bwd[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[..., None, None]
        gap = gold_hot - node
        grad_emit = np.zeros((n_features + 1, n_labels))
        np.add.at(grad_emit, feats.reshape(-1), np.repeat(gap.reshape(-1, n_labels), width, axis=0))
        grads = [grad_emit[:-1] / count - l2 * emit, (gold_move - edge.sum((0, 1))) / count - l2 * move, (gap[:, 0].sum(0)) / count - l2 * start]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.999**r)) + 1e-8)
    return Chain(*params)
