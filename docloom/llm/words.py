"""Words of whole Arrow batches of text at once.

A word is a run of bytes other than space and 0x09 to 0x0D. In UTF-8 these bytes stand for nothing
else, so words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docloom.llm import grams

#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK = 1 << 19
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Chunk:
    """Consecutive rows of a batch: their bytes, each text ended by a newline, and their words."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.rows = first, len(texts)
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.bounds = np.r_[0, np.cumsum(lengths)]
        edge = np.diff(np.r_[True, BLANK[self.data], True].astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        #: row of each word, and words of each row
        self.row = np.searchsorted(self.bounds, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)

    def hashes(self, lower: bool = False, family: int = 0) -> np.ndarray:
        """64-bit names of the words, alike wherever a word stands."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        data = LOWER[self.data] if lower else self.data
        room = 1 << max(20, int(len(data) + 1).bit_length())
        return grams.span_hash(grams.prefix_sums(grams.BYTE_NAMES[family][data], room), self.start, self.end, room)

    def shingles(self, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of runs of n words within a row, and their rows; a shorter row is one run."""
        size = len(names)
        out = np.zeros(size, np.uint64)
        place = np.arange(size) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        left = np.repeat(self.count, self.count) - place
        for k in range(n):
            reach = np.minimum(np.arange(size) + k, size - 1)
            out = np.where(left > k, grams.pair(out, names[reach], 1, 2), out)
        whole = (left >= n) | (place == 0)
        return grams.mix64(out[whole]), self.row[whole]


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """All rows of a binary column, null as empty, in chunks."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(column.to_pylist()):
        text = text or b""
        if held and size + len(text) > CHUNK:
            yield Chunk(first, held)
            held, size, first = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield Chunk(first, held)
