"""Token ids of words that were met before, in two generations.

A worker keeps what it has encoded in a table of bounded size.  When the newer
generation is full it becomes the older one, and a new one begins; a word met
in the older one moves over.  So rare words fall out and frequent ones stay.
Ids lie in one flat array, with no array of its own for a word.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

HELD_WORDS = 150_000  # words of a generation, or those of one call if they are more


class _Generation:
    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # ends[k] is where word k begins

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self.index), self.ends[len(self.index)]
        ends = total + np.cumsum(sizes)
        if len(words) and ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat[:total], np.empty(int(ends[-1] * 5 // 4 - total), np.uint32)))
        if n + len(words) >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(n + len(words) + 1, np.int64)))
        self.flat[total : total + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = ends
        self.index.update(zip(words, range(n, n + len(words))))

    def spans(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.ends[place]
        return first, self.ends[place + 1] - first


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(first - before, sizes) + np.arange(sizes.sum())]


class HeldIds:
    """``encode`` gives, for words, the same words in any order with their ids
    in a row and the number of ids of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = HELD_WORDS):
        self.encode, self.limit = encode, limit
        self.new, self.old = _Generation(), _Generation()

    def _look_up(self, generation: _Generation, words: list[str]) -> np.ndarray:
        return np.fromiter(map(generation.index.get, words, repeat(-1)), np.int64, len(words))

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the distinct words begins in ``flat``, and its number of ids."""
        if self.new.index and len(self.new.index) + len(words) > self.limit:
            self.new, self.old = _Generation(), self.new
        place = self._look_up(self.new, words)
        absent = np.flatnonzero(place < 0)
        if len(absent):
            some = [words[k] for k in absent.tolist()]
            known = self._look_up(self.old, some)
            there = np.flatnonzero(known >= 0)
            first, sizes = self.old.spans(known[there])
            self.new.add([some[k] for k in there.tolist()], gather(self.old.flat, first, sizes), sizes)
            rest = [some[k] for k in np.flatnonzero(known < 0).tolist()]
            if rest:
                self.new.add(*self.encode(rest))
            place[absent] = self._look_up(self.new, some)
        return self.new.spans(place)

    @property
    def flat(self) -> np.ndarray:
        return self.new.flat
