"""Byte-level BPE ids of whole Arrow columns with the tokenizers library.

The tokenizer splits a text into pieces (words, numbers, runs of signs, white
space, English endings) and encodes each piece on its own.  Here numpy splits, by
the same rule, and the library encodes each distinct piece once.  Pieces are
remembered by their bytes, so no two are ever confused.  A text with an added
token such as <|endoftext|> goes to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from colonnade.llm.text import mix

#: Short pieces that a worker remembers at most, ids kept before it starts anew, and bytes of a short piece.
SLOTS, KEPT_IDS, SHORT = 1 << 20, 1 << 24, 23
#: Texts are cut into parts of about this many characters, where a piece is sure to begin.
PART = 1 << 18
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LETTER, _NUMBER, _SIGN, _SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, sign or white space by code point."""
    table = np.full(0x110000, _SIGN, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    # White_Space of Unicode.
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = _SPACE
    return table


def piece_starts(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First code points of the pieces of texts end to end; ``edges``: the texts' first code points.

    A run of one class is a piece, with one space before it if there is one.
    White space before other characters leaves its last one off; that one is a
    piece of its own unless it is the space that belongs to the next piece.  A
    piece that begins with an apostrophe ends after an English ending.
    """
    kind = classes()[code]
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    edges = edges[edges < n]
    change[edges] = True
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    first = np.zeros(n, bool)
    first[run] = True
    at_edge = np.zeros(n + 1, bool)
    at_edge[edges] = True
    at_edge[n] = True
    # White space with something after it in the same text.
    space = np.flatnonzero((kind[run] == _SPACE) & ~at_edge[end])
    last = end[space] - 1
    first[last] = True
    lent = code[last] == 0x20
    first[end[space][lent]] = False
    # The endings 's 't 'm 'd 're 've 'll.
    mark = np.flatnonzero((code == 0x27) & first)
    mark = mark[(mark + 1 < n) & ~at_edge[np.minimum(mark + 1, n)]]
    if len(mark):
        one = code[mark + 1]
        inside = (mark + 2 < n) & ~at_edge[np.minimum(mark + 2, n)]
        two = np.where(inside, code[np.minimum(mark + 2, n - 1)], 0)
        single = (one == 0x73) | (one == 0x74) | (one == 0x6D) | (one == 0x64)
        double = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        mark, size = mark[single | double], np.where(double, 3, 2)[single | double]
        first[mark + 1] = False
        after = mark + size
        first[after[after < n]] = True
    return np.flatnonzero(first)


class Encoder:
    """Ids of texts; distinct pieces are looked up, new ones are encoded in one call."""

    def __init__(self, path: str):
        # The library's own threads would each keep memory; Spark's tasks are the parallelism here.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        #: The kind of the ids: two bytes where they hold every id.
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.spaced = np.array([str(self.tokenizer.id_to_token(k)).startswith("\u0120") for k in range(size)])
        self._clear()

    def _clear(self) -> None:
        # A slot holds one short piece, as its bytes and length; pieces that lose a slot are encoded when met.
        self.words = [np.zeros(SLOTS, np.uint64) for _ in range(3)]
        self.first = np.zeros(SLOTS, np.int32)
        self.count = np.zeros(SLOTS, np.int32)
        self.long: dict[str, tuple[int, int]] = {}
        self.ids = np.zeros(1 << 20, self.kind)
        self.used = 0

    def _keep(self, flat: np.ndarray) -> int:
        """Put ids behind those kept; returns where they begin."""
        if self.used + len(flat) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(flat)), self.kind)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        at = self.used
        self.ids[at : at + len(flat)] = flat
        self.used += len(flat)
        return at

    def _new_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each piece begin among those kept, their number)."""
        first, count = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1)
        words = [k for k, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and p[1:].isalpha()]
        # Words with their space in front split where they were joined, and a
        # word's first id alone begins with the space.
        groups = [words[k : k + 1000] for k in range(0, len(words), 1000)]
        for group in groups:
            ids = self._whole(["".join([pieces[k] for k in group])])[0]
            begin = np.flatnonzero(self.spaced[ids])
            if len(begin) == len(group):
                first[group] = self._keep(ids) + begin
                count[group] = np.diff(begin, append=len(ids))
        rest = np.flatnonzero(count < 0).tolist()
        if rest:
            got = self._whole([pieces[k] for k in rest])
            count[rest] = own = np.fromiter(map(len, got), np.int64, len(got))
            first[rest] = self._keep(np.concatenate(got)) + np.cumsum(own) - own
        return first, count

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, number of ids by text); long texts are encoded part by part."""
        ids, counts = [np.zeros(0, self.kind)], np.zeros(len(texts), np.int64)
        held, owners, size = [], [], 0

        def flush():
            nonlocal held, owners, size
            if held:
                own, n = self._block(held)
                ids.append(own)
                np.add.at(counts, owners, n)
            held, owners, size = [], [], 0

        for k, text in enumerate(texts):
            if any(token in text for token in self.added):
                flush()
                ids += self._whole([text])
                counts[k] = len(ids[-1])
                continue
            for part in _parts(text):
                held.append(part)
                owners.append(k)
                size += len(part)
                if size >= PART:
                    flush()
        flush()
        return np.concatenate(ids), counts

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(lengths) - lengths
        begin = piece_starts(code, edges[lengths > 0])
        if not len(begin):
            return np.zeros(0, self.kind), np.zeros(len(lengths), np.int64)
        end = np.append(begin[1:], len(code))
        first, count = self._places(joined, code, begin, end)
        total = np.cumsum(count)
        take = np.arange(int(total[-1])) + np.repeat(first - (total - count), count)
        by_text = np.searchsorted(begin, np.append(edges, len(code)))
        running = np.concatenate([[0], total])
        return self.ids[take], np.diff(running[by_text])

    def _places(self, joined: str, code: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(where the ids of each piece begin among those kept, their number)."""
        if self.used > KEPT_IDS:
            self._clear()
        at = np.zeros(len(code) + 1, np.int32)
        np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=at[1:])
        raw = joined.encode() + bytes(24)
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        place, size = at[begin], at[end] - at[begin]
        short = size <= SHORT
        some = np.flatnonzero(short)
        place, size = place[some], size[some]
        words = [eight[place + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)] for k in range(3)]
        words[2] |= size.astype(np.uint64) << np.uint64(56)
        slot = (mix(words[0] ^ mix(words[1] ^ mix(words[2]))) & np.uint64(SLOTS - 1)).astype(np.int64)
        own_first, own_count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(_differ(words, [w[slot] for w in self.words]))
        if len(new):
            order = new[np.lexsort([w[new] for w in words])]
            fresh = np.ones(len(order), bool)
            fresh[1:] = _differ([w[order[1:]] for w in words], [w[order[:-1]] for w in words])
            which = np.cumsum(fresh) - 1
            distinct = order[fresh]
            where = some[distinct]
            pieces = [joined[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
            kept, n = self._new_pieces(pieces)
            # Of new pieces for one slot, one is remembered.
            there, last = np.unique(slot[distinct], return_index=True)
            for mine, theirs in zip(self.words, words, strict=True):
                mine[there] = theirs[distinct[last]]
            self.first[there], self.count[there] = kept[last], n[last]
            own_first[order], own_count[order] = kept[which], n[which]
        first, count = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        first[some], count[some] = own_first, own_count
        far = np.flatnonzero(~short)
        if len(far):
            pieces = [joined[a:b] for a, b in zip(begin[far].tolist(), end[far].tolist(), strict=True)]
            unknown = list(dict.fromkeys(p for p in pieces if p not in self.long))
            if unknown:
                kept, n = self._new_pieces(unknown)
                self.long.update(zip(unknown, zip(kept.tolist(), n.tolist(), strict=True), strict=True))
            first[far], count[far] = np.array([self.long[p] for p in pieces], np.int64).T
        return first, count


def _differ(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    return (x[0] != y[0]) | (x[1] != y[1]) | (x[2] != y[2])


#: The first k bytes of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _parts(text: str):
    """Consecutive parts of about PART characters; each but the first begins with a space between letters."""
    at = 0
    while len(text) - at > 2 * PART:
        found = _CUT.search(text, at + PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def texts_of(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()
