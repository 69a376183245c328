"""Words of many texts at once as numpy arrays: where they stand, and hashes of them and of runs of them."""

from __future__ import annotations

import numpy as np

from cuelake.llm.decontam import _Powers, mixed


class Words:
    """The words of ``texts`` after ``table`` has been applied to their bytes; spaces and line ends stand between words.

    ``joined`` has all bytes, each text followed by a line end; ``start`` and ``end`` bound each word in it, ``many`` is
    the number of words of each text and ``base`` the number of its first word."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.data = b"\n".join([*texts, b""]).translate(table)
        self.joined = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(self.joined) + 2, np.int8)
        inside[1:-1] = (self.joined != 32) & (self.joined != 10)
        change = np.diff(inside)
        self.start, self.end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        bounds = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        ends = np.searchsorted(self.start, bounds)
        self.base = np.r_[0, ends[:-1]].astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.many = ends - self.base
        self.owner = np.repeat(np.arange(len(texts)), self.many)

    def hashes(self) -> np.ndarray:
        """A hash of each word: differences of prefix sums of a polynomial modulo 2^64, brought to the same power."""
        _Powers.to(len(self.joined) + 1)
        total = np.zeros(len(self.joined) + 1, np.uint64)
        np.cumsum((self.joined.astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(self.joined)], out=total[1:])
        return mixed((total[self.end] - total[self.start]) * _Powers.down[self.start])
