"""Cache admission: when a lookup's keys should be inserted, judged by hit rates."""

from __future__ import annotations

import math
import random
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol


class InsertHeuristic(Protocol):
    def insert_needed(self, hit_rate: float, table_id: int) -> bool: ...


class Never:
    def insert_needed(self, hit_rate: float, table_id: int) -> bool:
        return False


class Chance:
    """Insert with probability 1 - h below the table's threshold and (1 - h) cubed from there on."""

    def __init__(self, thresholds: list[float], seed: int = 1):
        self.thresholds, self.rng = thresholds, random.Random(seed)

    def insert_needed(self, hit_rate: float, table_id: int) -> bool:
        miss = 1.0 - hit_rate
        return self.rng.random() < (miss if hit_rate < self.thresholds[table_id] else miss**3)


class Change:
    """Insert at first, and whenever the hit rate has moved by the threshold since the last insert."""

    def __init__(self, thresholds: list[float]):
        self.thresholds, self.last = thresholds, [None] * len(thresholds)

    def insert_needed(self, hit_rate: float, table_id: int) -> bool:
        threshold, last = self.thresholds[table_id], self.last[table_id]
        if threshold <= 0 or last is not None and abs(hit_rate - last) < threshold:
            return False
        self.last[table_id] = hit_rate
        return True


def chebyshev(k: float, n: int) -> float:
    """At most this share lies k or more sample deviations from the mean of n samples: the bound for finite samples."""
    return math.floor((n + 1) / n * ((n - 1) / (k * k) + 1)) / (n + 1)


class Window:
    """A sliding mean of hit rates over a fixed length, missing samples counted as 0."""

    def __init__(self, length: int = 14):
        self.values = deque([0.0] * length, length)

    def add(self, x: float) -> None:
        self.values.append(x)

    def mean(self) -> float:
        return sum(self.values) / len(self.values)

    def variance(self, n_keys: int = 0) -> float:
        m = self.mean()
        if n_keys > 0:
            return m * (1 - m) / n_keys
        return sum((x - m) ** 2 for x in self.values) / (len(self.values) - 1)


@dataclass
class _Track:
    """What one table's samples have shown so far."""

    window: Window
    phase: str = "filling"
    filled: int = 0
    inserts: int = 0
    off: int = 0


class Statistical:
    """Insert in rounds until inserting no longer moves the hit rate; then again once samples leave the steady mean.

    Each table goes through phases of its own. Filling: a window of samples, no inserts. Inserting:
    ``rounds`` times yes. Probing: one sample tells whether the inserts moved the rate by k deviations;
    if so, a new window fills (unless a draw puts it down to chance, as Chebyshev's bound allows), else
    the rate is steady. Steady: samples within k deviations move the window; ``patience`` in a row
    outside, on either side, start inserting. With ``n_keys`` the deviation is that of a share of so many
    draws, else the window's own.
    """

    def __init__(self, k: Sequence[float] = (3.0,), length: int = 14, rounds: int = 50, patience: int = 3, n_keys: int = 0, seed: int = 1):
        if not k or min(k) <= 0 or length < 2 or rounds < 1 or patience < 1:
            raise ValueError("k must be positive, length above 1, rounds and patience at least 1")
        self.k, self.length, self.rounds, self.patience, self.n_keys = list(k), length, rounds, patience, n_keys
        self.rng, self.tracks = random.Random(seed), [_Track(Window(length)) for _ in k]

    def insert_needed(self, hit_rate: float, table_id: int = 0) -> bool:
        if not 0 <= table_id < len(self.tracks):
            raise ValueError(f"no table {table_id}")
        t = self.tracks[table_id]
        if t.phase == "inserting":
            t.inserts += 1
            if t.inserts % self.rounds == 0:
                t.phase = "probing"
            return True
        outside = t.phase != "filling" and abs(hit_rate - t.window.mean()) >= self.k[table_id] * math.sqrt(t.window.variance(self.n_keys))
        if t.phase == "steady" and outside:
            t.off += 1
            if t.off == self.patience:
                t.phase, t.off = "inserting", 0
            return False
        t.off = 0
        t.window.add(hit_rate)
        if t.phase == "filling":
            t.filled += 1
            if t.filled == self.length:
                t.phase = "inserting"
        elif t.phase == "probing":
            moved = outside and self.rng.random() > chebyshev(self.k[table_id], self.length)
            t.phase, t.filled = ("filling", 1) if moved else ("steady", t.filled)
        return False


def default_thresholds(on_device: Sequence[bool], threshold: float = 0.75) -> list[float]:
    """Each tier's threshold: the common one, but 0 for the last tier that is on the host, where every row ends up."""
    last = max((i for i, device in enumerate(on_device) if not device), default=None)
    return [0.0 if i == last else threshold for i in range(len(on_device))]
