"""Words, word hashes and word shingles of Arrow text columns, as numpy arrays.

Everything works on UTF-8 bytes without a Python string per row.  A word is a
maximal run of ASCII digits, ASCII letters and non-ASCII characters; A-Z count
as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once: intermediate arrays take about 60 times as much.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 32
    return table


WORD_BYTES = _word_bytes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(
                np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, _BASE)])
            )
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words of some texts: start and end byte, text number, hash; ``first`` as offsets by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        shown = WORD_BYTES[data]
        inside = shown != 0
        size = len(data)
        begins = inside.copy()
        ends = inside.copy()
        if size:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < size]
            begins[edge] = inside[edge]
            last = offsets[1:] - 1
            last = last[last >= 0]
            ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(n + 1))
        length = self.end - self.start
        self.hash = np.zeros(len(length), np.uint64)
        if len(length):
            at = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(at, length)
            with np.errstate(over="ignore"):
                terms = shown[inside].astype(np.uint64) * powers(int(length.max()) + 1)[place]
                summed = np.add.reduceat(terms, at)
                self.hash = mix(summed + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hash(word: str) -> np.uint64:
    """The hash that ``Words`` gives this single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    found = Words(data, np.array([0, len(data)])).hash
    if len(found) != 1:
        raise ValueError(f"not one word: {word!r}")
    return found[0]


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of k words.

    A text of 1 to k - 1 words has one run, of all its words; a text without
    words has none.
    """
    h, n = words.hash, len(words.hash)
    counts = words.counts
    with np.errstate(over="ignore"):
        full = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k if n >= k else 0):
            full += h[j : n - k + 1 + j] * powers(k + 1)[j + 1]
        full = mix(full)
    if n >= k:
        whole = words.text[: n - k + 1] == words.text[k - 1 :]
        full, owner = full[whole], words.text[: n - k + 1][whole]
    else:
        owner = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k - 1):
                has = counts[short] > j
                own[has] += h[words.first[short[has]] + j] * powers(k + 1)[j + 1]
            own = mix(own + counts[short].astype(np.uint64))
        full, owner = np.concatenate([full, own]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, owner


def distinct_windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and count of the distinct runs, by text and then hash."""
    h, owner = windows(words, k)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if not len(h):
        return h, owner, np.zeros(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], owner[at], np.diff(np.append(at, len(h)))
