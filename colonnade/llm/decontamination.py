"""Benchmark decontamination by spaced seeds.

A mask looks at some positions of a run of words and ignores the others, so a
run with a replaced word still hashes alike under a mask that ignores its
place.  The hashes of all runs of the benchmark are joined with those of the
documents; around each hit the two word sequences are aligned and the best
stretch, with substitutions allowed, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.text import Words, blocks, mix, powers, utf8

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("11101011011", "1101100110101", "111001101111", "11111111")
#: Masks of four: one of them fits every stretch of 13 words or more with SIMILAR equal words.
LIGHT = ("1111", "11101")
#: Masks of three for items of less than OVERLAP words; likewise for any such item of 4 words or more.
LIGHTEST = ("111", "1101", "1011")
#: Words of an aligned stretch that count as a leak (a shorter item: all of it).
OVERLAP = 13
#: Share of equal words in the stretch.
SIMILAR = 0.75
#: Words of benchmark text held by each worker at once.
BENCHMARK_WORDS = 1 << 20
#: Pairs of words compared at once.
COMPARED_WORDS = 1 << 20


def spaced(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run under the mask, and the runs' first words."""
    n, span = len(words.hash), len(mask)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - span + 1, np.uint64)
    factor = powers(span + 2)
    with np.errstate(over="ignore"):
        for j, used in enumerate(mask):
            if used == "1":
                total += words.hash[j : n - span + 1 + j] * factor[j + 1]
    at = np.flatnonzero(words.text[: n - span + 1] == words.text[span - 1 :])
    return mix(total[at]), at


class Seeds:
    """All runs of some benchmark items, by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        raw = [t.encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, raw)])
        words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.words, self.counts = words, words.counts
        self.items = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(items))]
        self.masks = []
        for mask in MASKS + LIGHT + LIGHTEST:
            h, at = spaced(words, mask)
            if mask in LIGHTEST:
                some = self.counts[words.text[at]] < OVERLAP
                h, at = h[some], at[some]
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            item = words.text[at][order]
            self.masks.append((mask, h[order], item, at[order] - words.first[item], self._filter(h)))
        # Items too short to hold a replaced word are found by their first word and compared whole.
        shortest = min(map(len, LIGHTEST)) + 1
        short = [(x[0], k) for k, x in enumerate(self.items) if 0 < len(x) < shortest]
        h = np.array([x for x, _ in short], np.uint64)
        order = np.argsort(h, kind="stable")
        item = np.array([k for _, k in short], np.int64)[order]
        self.short = (h[order], item, np.zeros(len(item), np.int64), self._filter(h))

    @staticmethod
    def _filter(h: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[(h >> np.uint64(44)).astype(np.int64)] = True
        return seen

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, item, word of the text under the item's word 0), with enough equal words in all.

        A run that stands everywhere is verified a part at a time, so a hit may come more than once.
        """
        found, size = [], 0
        sides = [(*spaced(words, m), h, item, at, seen) for m, h, item, at, seen in self.masks]
        h, item, at, seen = self.short
        if len(h):
            sides.append((words.hash, np.arange(len(words.hash)), h, item, at, seen))
        for runs, first, keys, item, at, seen in sides:
            if not len(keys) or not len(runs):
                continue
            some = np.flatnonzero(seen[(runs >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(keys, runs[some], "left")
            count = np.searchsorted(keys, runs[some], "right") - lo
            some, lo, count = some[count > 0], lo[count > 0], count[count > 0]
            if not len(some):
                continue
            begin = 0
            while begin < len(some):
                # Runs of the text with at most COMPARED_WORDS places in the items, one at least.
                total = np.cumsum(count[begin:])
                end = begin + max(1, int(np.searchsorted(total, COMPARED_WORDS - size, "right")))
                own, runs_at = count[begin:end], first[some[begin:end]]
                each = np.repeat(np.arange(len(own)), own)
                k = lo[begin:end][each] + np.arange(len(each)) - np.repeat(np.cumsum(own) - own, own)
                found.append(np.stack([words.text[runs_at][each], item[k], runs_at[each] - at[k]], 1))
                size += len(each)
                begin = end
                if size >= COMPARED_WORDS:
                    yield from self._likely(words, np.unique(np.concatenate(found), axis=0))
                    found, size = [], 0
        if found:
            yield from self._likely(words, np.unique(np.concatenate(found), axis=0))

    def _likely(self, words: Words, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The hits whose two sequences have as many equal words as the shortest leak."""
        text, item, zero = hits.T
        skip = np.maximum(0, words.first[text] - zero)
        size = np.minimum(self.counts[item], words.first[text + 1] - zero) - skip
        total = np.cumsum(size)
        begin = 0
        while begin < len(hits):
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + COMPARED_WORDS, "right")))
            own = size[begin:end]
            first = np.cumsum(own) - own
            place = np.arange(int(own.sum())) - np.repeat(first - skip[begin:end], own)
            there = words.hash[place + np.repeat(zero[begin:end], own)]
            here = self.words.hash[place + np.repeat(self.words.first[item[begin:end]], own)]
            equal = np.add.reduceat(there == here, first, dtype=np.int64)
            enough = equal >= SIMILAR * np.minimum(OVERLAP, self.counts[item[begin:end]])
            yield from hits[begin:end][enough].tolist()
            begin = end


def best_stretch(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """(first, end) of the best stretch of ``least`` words or more; None if there is none.

    The best has the most equal words less, for each other one, as many as keep
    a stretch with a share of SIMILAR equal words at 0: a stretch of that length
    and share exists exactly if the best is not below 0.
    """
    if len(same) < least:
        return None
    loss = round(SIMILAR / (1 - SIMILAR))
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -loss))])
    low = np.minimum.accumulate(total[: len(total) - least])
    gain = total[least:] - low
    k = int(np.argmax(gain))
    if gain[k] < 0:
        return None
    first = int(np.flatnonzero(total[: k + 1] == low[k])[-1])
    return first, k + least


def leaks_in(words: Words, seeds: Seeds) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item index, first word in text, length, equal words) of verified overlaps."""
    for text, item, zero in seeds.hits(words):
        goal = seeds.items[item]
        lo, hi = int(words.first[text]), int(words.first[text + 1])
        skip = max(0, lo - zero)
        stop = min(len(goal), hi - zero)
        if stop <= skip:
            continue
        same = words.hash[zero + skip : zero + stop] == goal[skip:stop]
        stretch = best_stretch(same, min(OVERLAP, len(goal)))
        if stretch:
            first, end = stretch
            yield text, item, zero + skip + first - lo, end - first, int(same[first:end].sum())


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    part, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")))
    for item_id, text in items.toLocalIterator():
        part.append((-1 if item_id is None else item_id, text))
        size += len(text) // 4 + 1
        if size >= BENCHMARK_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Verified overlaps: one row per row of ``docs`` and item.

    Returns ``key``, item_id, first_word, n_words, n_equal of the best overlap.
    ``docs`` is read once per block of BENCHMARK_WORDS words of the benchmark.
    Null texts count as empty and never match; items without words are passed
    over, a null item_id reads -1; repeated rows are found each; an empty table
    on either side gives an empty result.  Other columns are ignored.
    """
    schema = f"{key} long, item_id long, first_word long, n_words long, n_equal long"
    result = None
    for items in _item_blocks(benchmark):

        def run(batches, items=items):
            seeds = Seeds(items)
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                out = []
                for i, j in blocks(offsets):
                    words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best: dict = {}
                    for text, item, *what in leaks_in(words, seeds):
                        at = (text + i, item)
                        if at not in best or what[2] > best[at][2]:
                            best[at] = what
                    out += [(t, int(seeds.ids[k]), *what) for (t, k), what in best.items()]
                ids = batch.column(0).take(pa.array([x[0] for x in out], pa.int64()))
                rest = [pa.array([x[c] for x in out], pa.int64()) for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays([ids, *rest], [x.split()[0] for x in schema.split(", ")])

        found = docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, schema)
        result = found if result is None else result.union(found)
    if result is None:
        return docs.sparkSession.createDataFrame([], schema)
    return result


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with a leak: ``key``, n_items, items (ids, comma-joined), most_equal.

    One row for each ``key``: rows that repeat one count together, and so do
    those whose ``key`` is null.  Null and empty texts and items are never found;
    an empty table on either side gives an empty result.
    """
    return (
        find_leaks(docs, benchmark, key)
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("item_id")).alias("_i"), F.max("n_equal").alias("most_equal"))
        .select(
            key,
            F.size("_i").cast("long").alias("n_items"),
            F.array_join(F.col("_i").cast("array<string>"), ",").alias("items"),
            "most_equal",
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found; no shuffle.

    Null and empty texts stay; repeated rows are judged each, whatever their id;
    an empty benchmark keeps all; an empty table gives an empty result.
    """
    at = docs.columns.index("text")
    for items in _item_blocks(benchmark):

        def run(batches, items=items):
            seeds = Seeds(items)
            for batch in batches:
                data, offsets = utf8(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for i, j in blocks(offsets):
                    words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    clean[[i + leak[0] for leak in leaks_in(words, seeds)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
