"""Quality scores from preference pairs: a Bradley-Terry model over text features.

A pair is a text labelled good and one labelled bad; the model's score is
linear in the features, and the chance that the good one is preferred is the
logistic function of the difference of their scores.  Weights minimise the mean
logistic loss over all pairs of all labelled texts.  The threshold is a quantile
of all training scores: the one at the share of bad labels.

No pair is written out.  Loss, gradient and Hessian are sums over pairs of smooth
functions of a difference of scores times features of either side.  Such a
function is interpolated in both scores at the nodes of cells of width 1, so each
side is told by its sums at the nodes: one pass over the texts, whatever the
number of pairs.  With NODES nodes a cell the relative error is about 1e-10.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.text import Words, blocks, utf8
from colonnade.llm.work import cut

RIDGE = 1e-3
#: Nodes of a cell of scores.
NODES = 10

#: Byte classes counted in a text; every other byte is "other".
_SIGNS = "!#$%&*|.,?:;-_@/\\()<>=+~^'\"[]{}"
CLASSES = ["upper", "lower", "digit", "space", "newline", "wide", *_SIGNS, "other"]
NAMES = [
    *CLASSES, "log_length", "log_words", "word_length", "repeated_next", "distinct_words", "capital_words",
    "sign_share", "line_length", "no_text",
]


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for b in range(256):
        c = chr(b)
        if "A" <= c <= "Z":
            table[b] = 0
        elif "a" <= c <= "z":
            table[b] = 1
        elif "0" <= c <= "9":
            table[b] = 2
        elif c == "\n":
            table[b] = 4
        elif c in " \t\r":
            table[b] = 3
        elif b >= 0x80:
            table[b] = 5
        elif c in _SIGNS:
            table[b] = CLASSES.index(c)
    return table


_TABLE = _class_table()


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, k = len(offsets) - 1, len(CLASSES)
    size = np.diff(offsets)
    kind = _TABLE[data]
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * k + kind, minlength=n * k).reshape(n, k).astype(np.float64)
    length = np.maximum(size, 1)
    words = Words(data, offsets)
    total = words.counts
    some = np.maximum(total, 1)
    letters = np.bincount(words.text, weights=words.end - words.start, minlength=n)
    next_same = np.zeros(n)
    capital = np.zeros(n)
    distinct = np.zeros(n)
    if len(words.hash):
        same = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
        next_same = np.bincount(words.text[1:][same], minlength=n).astype(np.float64)
        shout = (kind[words.start] == 0) & (kind[words.end - 1] == 0) & (words.end - words.start > 1)
        capital = np.bincount(words.text[shout], minlength=n).astype(np.float64)
        order = np.lexsort((words.hash, words.text))
        h, t = words.hash[order], words.text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        distinct = np.bincount(t[new], minlength=n).astype(np.float64)
    lines = counts[:, 4] + 1
    signs = counts[:, 6:].sum(1)
    share = np.sqrt(counts / length[:, None])
    more = [
        np.log1p(size), np.log1p(total), letters / some, np.sqrt(next_same / some), distinct / some,
        np.sqrt(capital / some), np.sqrt(np.minimum(signs / some, 4)), np.log1p(size / lines), (total == 0) * 1.0,
    ]
    return np.concatenate([share, np.stack(more, 1)], 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; null counts as empty."""
    data, offsets = utf8(column)
    parts = [np.zeros((0, len(NAMES)))]
    for i, j in blocks(offsets):
        parts.append(_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
    return np.concatenate(parts)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold maps to 0.5."""
        raw = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


#: Chebyshev points of a cell from its middle, and the matrix from polynomials to the weights of the nodes.
_POINTS = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)) / 2
_TO_NODES = np.polynomial.chebyshev.chebvander(2 * _POINTS, NODES - 1).T * np.where(np.arange(NODES), 2, 1)[:, None] / NODES


def _basis(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each score, and its weight at each node of the cell."""
    cell = np.floor(score)
    return cell.astype(np.int64), np.polynomial.chebyshev.chebvander(2 * (score - cell) - 1, NODES - 1) @ _TO_NODES


class Held:
    """Training rows in memory."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.x, self.good = x, good.astype(bool)

    def total(self, part) -> tuple[np.ndarray, np.ndarray]:
        """The values of part(x, good), which gives ascending keys and values, summed by key over all rows."""
        return part(self.x, self.good)

    def neighbours(self, score, k: int) -> tuple[float, float]:
        """The k-th lowest score, from 0, and the next."""
        return tuple(np.sort(score(self.x))[k : k + 2])


class Stored:
    """Training rows of any number in a table (x, good); the driver sees sums only."""

    def __init__(self, table: DataFrame):
        self.table, self.rows = table, table.count()

    def __len__(self) -> int:
        return self.rows

    def _mapped(self, part, schema: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    yield part(x, batch.column(1).to_numpy(zero_copy_only=False))

        return self.table.mapInArrow(run, schema)

    def total(self, part) -> tuple[np.ndarray, np.ndarray]:
        def told(x, good):
            return pa.RecordBatch.from_arrays([pa.array(v) for v in part(x, good)], ["key", "value"])

        summed = self._mapped(told, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
        keys, values = summed["key"].to_numpy(), summed["value"].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    def neighbours(self, score, k: int) -> tuple[float, float]:
        """Exact, by 16 bits at a time of integers in the order of the scores."""
        most = np.int64(0x7FFFFFFFFFFFFFFF)

        def told(x, good):
            bits = score(x).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, bits ^ most, bits))], ["key"])

        keys = cut(self._mapped(told, "key long"), "training-scores")
        inside, head = keys, 0
        for shift in (48, 32, 16, 0):
            counts = inside.groupBy(F.shiftright("key", shift).alias("head")).count().collect()
            for head, n in sorted((r[0], r[1]) for r in counts):
                if k < n:
                    break
                k -= n
            inside = keys.filter(F.shiftright("key", shift) == head)
        after = head if k + 1 < n else keys.filter(F.col("key") > head).agg(F.min("key")).first()[0]
        found = np.array([head, after], np.int64)
        return tuple(np.where(found < 0, found ^ most, found).view(np.float64))


class _Side:
    """Texts of one label: the cells they are in, and number and features summed at the nodes."""

    def __init__(self, cells: np.ndarray, sums: np.ndarray):
        self.cells = cells
        self.score = (cells[:, None] + 0.5 + _POINTS).ravel()
        flat = sums.reshape(len(self.score), -1)
        self.n, self.z = flat[:, 0], flat[:, 1:]


def _spread(rows, standard, w: np.ndarray) -> tuple[_Side, _Side]:
    """Both sides, good and bad, at weights ``w``."""
    wide = NODES * (len(w) + 1)

    def part(x, good):
        z = standard(x)
        cell, basis = _basis(z @ w)
        place = cell * 2 + good
        held = np.concatenate([np.ones((len(z), 1)), z], 1)
        found = np.unique(place)
        sums = [(basis[place == p].T @ held[place == p]).ravel() for p in found]
        return (found[:, None] * wide + np.arange(wide)).ravel(), np.concatenate(sums)

    keys, values = rows.total(part)
    place, sums = keys[::wide] // wide, values.reshape(-1, wide)
    return tuple(_Side(place[place & 1 == side] >> 1, sums[place & 1 == side]) for side in (1, 0))


def _over_pairs(sides: tuple[_Side, _Side], kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of kernel(good score - bad score): sums by good node, by bad node, and of the product of both sides' features.

    Taken in blocks: scores with long tails have many cells.
    """
    good, bad = sides
    by_good, by_bad = np.zeros(len(good.n)), np.zeros(len(bad.n))
    across = np.zeros((good.z.shape[1], bad.z.shape[1]))
    size = max(1, 2_000_000 // len(bad.n))
    for i in range(0, len(good.n), size):
        block = slice(i, i + size)
        value = kernel(good.score[block, None] - bad.score[None, :])
        by_good[block] = value @ bad.n
        by_bad += good.n[block] @ value
        across += good.z[block].T @ (value @ bad.z)
    return by_good, by_bad, across


def _curve(apart: np.ndarray) -> np.ndarray:
    apart = np.abs(apart)
    return np.exp(-apart - 2 * np.log1p(np.exp(-apart)))


def _hessian(rows, standard, w: np.ndarray, sides: tuple[_Side, _Side]) -> np.ndarray:
    """Sum over pairs of p (1 - p) times the outer square of the difference."""
    by_good, by_bad, across = _over_pairs(sides, _curve)
    at = [(side.cells, by.reshape(-1, NODES)) for side, by in zip(sides, (by_good, by_bad), strict=True)]

    def part(x, good):
        z = standard(x)
        cell, basis = _basis(z @ w)
        total = np.zeros((len(w), len(w)))
        for (cells, value), mine in zip(at, (good, ~good), strict=True):
            # A score at the edge of a cell may be rounded to either side.
            found = np.minimum(np.searchsorted(cells, cell[mine]), len(cells) - 1)
            times = (basis[mine] * value[found]).sum(1)
            total += (z[mine] * times[:, None]).T @ z[mine]
        return np.arange(total.size), total.ravel()

    return rows.total(part)[1].reshape(len(w), len(w)) - across - across.T


def fit_pairs(x, good) -> Model:
    """Bradley-Terry by Newton steps on all (good, bad) pairs.

    ``x`` is an array with a row of features per text and ``good`` an array of
    their labels; or ``x`` is a ``Stored`` table, which has its labels.  Without
    rows of both labels there are no pairs: weights are 0 and every score is 0.5.
    """
    rows = x if isinstance(x, Stored) else Held(x, good)

    def sums(value):
        def part(x, good):
            total = np.concatenate([[len(x), good.sum()], value(x).sum(0)])
            return np.arange(len(total)), total

        return rows.total(part)[1]

    first = sums(lambda x: x) if len(x) else np.zeros(2 + len(NAMES))
    n, n_good, d = int(first[0]), int(first[1]), len(first) - 2
    if n_good in (0, n):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0)
    mean = first[2:] / n
    scale = np.sqrt(sums(lambda x: (x - mean) ** 2)[2:] / n)
    scale[scale < 1e-9] = 1.0
    bad = n - n_good
    pairs = float(n_good) * bad
    standard = lambda x: (x - mean) / scale

    def measured(w):
        sides = _spread(rows, standard, w)
        loss = sides[0].n @ _over_pairs(sides, lambda apart: np.logaddexp(0, -apart))[0] / pairs + RIDGE / 2 * w @ w
        by_good, by_bad, _ = _over_pairs(sides, lambda apart: np.exp(-np.logaddexp(0, apart)))
        return loss, (by_bad @ sides[1].z - by_good @ sides[0].z) / pairs + RIDGE * w, sides

    w = np.zeros(d)
    loss, gradient, sides = measured(w)
    for _ in range(50):
        step = np.linalg.solve(_hessian(rows, standard, w, sides) / pairs + RIDGE * np.eye(d), gradient)
        while True:
            after = measured(w - step)
            # The margin is for errors of rounding and interpolation.
            if after[0] <= loss + 1e-9 or np.abs(step).max() < 1e-6:
                break
            step = step / 2
        w, (loss, gradient, sides) = w - step, after
        if np.abs(step).max() < 1e-6:
            break
    # Halfway between the scores on both sides of the quantile.
    low, high = rows.neighbours(lambda x: standard(x) @ w, bad - 1)
    return Model(mean, scale, w, float((low + high) / 2))


def remainder(doc_id):
    """crc32 of the id's decimal text, modulo 3."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled documents whose remainder is not 1.

    Rows that repeat a doc_id count as one, with the text of the lowest hash; null
    texts count as empty; labels without an id or a quality are passed over.  Texts
    are not shuffled, only their features are.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    usable = labels.select(doc_id, (F.col("quality") == 1).alias("good"), "quality").filter("good IS NOT NULL").distinct()
    text = F.coalesce("text", F.lit(""))
    held = docs.select(doc_id, F.xxhash64(text).alias("hash"), text.alias("text")).filter(remainder("doc_id") != 1)

    def run(batches):
        for batch in batches:
            x = features(batch.column(2))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "hash", "x"]
            )

    found = held.mapInArrow(run, "doc_id long, hash long, x array<double>")
    found = found.groupBy("doc_id").agg(F.min_by("x", "hash").alias("x"))
    # A merge join at every size: the plan does not change as the input grows.
    rows = Stored(cut(found.join(usable.hint("merge"), "doc_id").select("x", "good"), "training-rows"))
    return fit_pairs(rows, "good")


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty; repeated rows keep a row each; a null doc_id is
    not held out; an empty table gives an empty result.  Other columns are
    ignored, and doc_id is no input of a score.
    """

    def run(batches):
        for batch in batches:
            score = model.score(features(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held_out = F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more.

    Null texts count as empty; repeated rows are judged each; nulls elsewhere
    play no part; an empty table gives an empty result.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
