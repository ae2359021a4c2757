"""A worker's table of words: each distinct word gets a row of numbers, computed once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Words kept per worker; bounds memory only. A table that has grown beyond starts anew.
MOST_WORDS = 350_000


class _Numbered(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


class WordTable:
    """Numbers for words, and the rows that ``compute`` gives for each new word."""

    def __init__(self, compute: Callable[[list], np.ndarray], width: int, dtype=np.float32):
        self.compute, self.width, self.dtype = compute, width, dtype
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbered()
        self.rows = np.empty((1024, self.width), dtype=self.dtype)

    def begin(self) -> None:
        """Call between slices: numbers given before may end here."""
        if len(self.numbers) > MOST_WORDS:
            self._clear()

    def look(self, words: Iterable, count: int) -> np.ndarray:
        """The number of each word; ``rows`` holds their rows afterwards."""
        known = len(self.numbers)
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, count)
        total = len(self.numbers)
        if total > known:
            if total > len(self.rows):
                grown = np.empty((max(total, 2 * len(self.rows)), self.width), dtype=self.dtype)
                grown[:known] = self.rows[:known]
                self.rows = grown
            new = list(self.numbers)[known:] if known * 4 < total else [w for w, _ in zip(reversed(self.numbers), range(total - known))][::-1]
            self.rows[known:total] = self.compute(new)
        return found
