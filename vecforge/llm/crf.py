"""A linear-chain conditional random field over hashed binary features, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def feature_id(name: str, buckets: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % buckets


@dataclass
class Crf:
    """emit: (buckets, labels); move: (labels, labels) from row to column; start: (labels,)."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, features: Sequence[Sequence[int]]) -> np.ndarray:
        """(positions, labels): the summed weights of each position's features."""
        lengths = [len(f) for f in features]
        flat = np.fromiter((i for f in features for i in f), np.int64, sum(lengths))
        at = np.repeat(np.arange(len(features)), lengths)
        return np.stack([np.bincount(at, self.emit[flat, k], len(features)) for k in range(len(self.start))], 1)

    def viterbi(self, scores: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> list[int]:
        """The best labels; start and end are added to the first and last position's labels."""
        n, k = scores.shape
        move = self.move.tolist()
        best = (scores[0] + (self.start if start is None else start)).tolist()
        back = []
        for row in scores[1:].tolist():
            came = [max(range(k), key=lambda i: best[i] + move[i][j]) for j in range(k)]  # noqa: B023
            best = [best[came[j]] + move[came[j]][j] + row[j] for j in range(k)]
            back.append(came)
        if end is not None:
            best = [b + e for b, e in zip(best, end.tolist(), strict=True)]
        path = [max(range(k), key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(sequences: Sequence[tuple[Sequence[Sequence[int]], Sequence[int]]], labels: int, buckets: int, rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with an L2 penalty, by full-batch adaptive gradient steps; deterministic.

    ``sequences`` holds (features of each position, label of each position).
    """
    n, longest = len(sequences), max(len(y) for _, y in sequences)
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), np.int64)
    flat, at = [], []
    for s, (xs, ys) in enumerate(sequences):
        mask[s, : len(ys)] = True
        gold[s, : len(ys)] = ys
        for t, x in enumerate(xs):
            flat += x
            at += [s * longest + t] * len(x)
    flat, at = np.array(flat), np.array(at)
    model = Crf(np.zeros((buckets, labels)), np.zeros((labels, labels)), np.zeros(labels))
    onehot = np.eye(labels)[gold] * mask[..., None]
    truth_move = np.einsum("sti,stj->ij", onehot[:, :-1] * mask[:, 1:, None], onehot[:, 1:])
    sums = [np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros_like(model.start)]
    for _ in range(rounds):
        e = np.stack([np.bincount(at, model.emit[flat, k], n * longest) for k in range(labels)], 1).reshape(n, longest, labels)
        forward = np.zeros((n, longest, labels))
        backward = np.zeros((n, longest, labels))
        forward[:, 0] = e[:, 0] + model.start
        for t in range(1, longest):
            step = _logsum(forward[:, t - 1, :, None] + model.move, 1) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(model.move + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        z = _logsum(forward[:, -1], 1)
        p = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        pair = forward[:, :-1, :, None] + model.move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expect_move = (np.exp(np.where(mask[:, 1:, None, None], pair, -np.inf))).sum((0, 1))
        gap = (onehot - p).reshape(-1, labels)
        grads = [np.stack([np.bincount(flat, gap[at, k], buckets) for k in range(labels)], 1), truth_move - expect_move, gap.reshape(n, longest, labels)[:, 0].sum(0)]
        for w, g, total in zip((model.emit, model.move, model.start), grads, sums, strict=True):
            g -= decay * n * w
            total += g * g
            w += rate * g / np.sqrt(total + 1e-8)
    return model
