"""Rows of varying length in flat numpy arrays, and a table of them by string."""

from __future__ import annotations

from itertools import islice

import numpy as np


#: Items that gather() takes at a time: their places take 8 bytes each.
GATHER = 1 << 20


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenate flat[start[i] : start[i] + length[i]] for all i."""
    end = np.cumsum(length)
    if not len(end) or end[-1] == 0:
        return flat[:0]
    out = np.empty(int(end[-1]), flat.dtype)
    for s in spans_of(length, GATHER):
        a = int(end[s.start - 1]) if s.start else 0
        step = np.repeat(start[s] - (end[s] - length[s] - a), length[s])
        step += np.arange(len(step))
        np.take(flat, step, out=out[a : a + len(step)])
    return out


class Numbers(dict):
    """Keys numbered in the order of their first look-up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class RaggedTable:
    """Numbers the strings it is given and keeps an id array for each of them.

    Bounded: a table over `most` strings starts afresh, so that a task's memory
    does not grow with its input. Only speed depends on what it remembers.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.rows = self.used = 0

    def __len__(self) -> int:
        return self.rows

    def index(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """Numbers of the keys, and the keys that are new, in the order of their numbers."""
        known = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        return found, list(islice(reversed(self.number), len(self.number) - known))[::-1]

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        """The id arrays of the new keys, in their order."""
        n, m = len(length), len(flat)
        while self.rows + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        end = np.cumsum(length)
        self.start[self.rows : self.rows + n] = self.used + end - length
        self.length[self.rows : self.rows + n] = length
        self.flat[self.used : self.used + m] = flat
        self.rows += n
        self.used += m

    def ids(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated ids of the numbered keys, and how many each has."""
        length = self.length[found]
        return gather(self.flat, self.start[found], length), length


def spans_of(sizes: np.ndarray, most: int):
    """Slices of consecutive items whose sizes add up to about `most`."""
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield slice(at, to)
        at = to
