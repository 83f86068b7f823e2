"""Homomorphic multiset fingerprints of documents.

Each paragraph (line with a word or other visible character) is hashed to a wide
vector of 32-bit lanes; a document's fingerprint is the sum of its paragraphs'
vectors modulo 2**32, lane by lane.  So the order of paragraphs does not matter,
and a paragraph is added to or taken from a fingerprint by adding or subtracting
its vector, without the rest of the text.

* ``EXACT`` lanes are pseudo-random functions of the whole paragraph: equal sums
  mean equal multisets of paragraphs, but for a chance of 2**-(32*EXACT).
* ``LIKE`` lanes hold a signed count sketch of the paragraph's word runs: the
  inner product of two documents' lanes estimates how many runs they share.  It
  holds for texts of up to 2**31 runs of words, beyond which lanes wrap.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.text import Words, blocks, mix, utf8, windows
from colonnade.llm.work import release_memory

EXACT, LIKE = 16, 256
LANES = EXACT + LIKE
#: Words of a run in the LIKE lanes.
RUN = 3


def exact_vector(paragraph: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(paragraph).digest(4 * EXACT), "<u4")


def fingerprint_array(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of LANES uint32) of UTF-8 texts end to end."""
    out = np.zeros((len(offsets) - 1, LANES), np.uint32)
    for i, j in blocks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        raw = part.tobytes()
        # Paragraphs as texts of their own, so that no run of words crosses one's end.
        begins = np.union1d(np.flatnonzero(part == 10) + 1, at)
        document = np.searchsorted(at, begins[:-1], "right") - 1
        h, owner = windows(Words(part, begins), RUN)
        if len(h):
            h = mix(h ^ np.uint64(0xA0761D6478BD642F))
            lane = (h >> np.uint64(1)) & np.uint64(LIKE - 1)
            sign = 1 - 2 * (h & np.uint64(1)).astype(np.int64)
            place = document[owner] * LIKE + lane.astype(np.int64)
            sums = np.bincount(place, weights=sign, minlength=(j - i) * LIKE)
            out[i:j, EXACT:] = sums.astype(np.int64).reshape(j - i, LIKE).astype(np.uint32)
        exact = out[i:j, :EXACT]
        for d, p, q in zip(document.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            paragraph = raw[p:q].removesuffix(b"\n")
            if paragraph and not paragraph.isspace():
                exact[d] += exact_vector(paragraph)
    return out


def fingerprint(text: str | None) -> np.ndarray:
    """Fingerprint of one text; null counts as empty, whose fingerprint is all zero."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return fingerprint_array(data, np.array([0, len(data)]))[0]


def insert(total: np.ndarray, paragraph: str) -> np.ndarray:
    """Fingerprint after adding a paragraph."""
    return (total + fingerprint(paragraph)).astype(np.uint32)


def delete(total: np.ndarray, paragraph: str) -> np.ndarray:
    return (total - fingerprint(paragraph)).astype(np.uint32)


def text_form(prints: np.ndarray) -> list[str]:
    """Lanes as little-endian bytes, base64."""
    raw = np.ascontiguousarray(prints.astype("<u4"))
    return [base64.b64encode(row.tobytes()).decode() for row in raw]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated share (0 to 1) of common word runs of fingerprints, row by row; 1 where they are equal."""
    a = x[:, EXACT:].astype(np.int32).astype(np.float64)
    b = y[:, EXACT:].astype(np.int32).astype(np.float64)
    both = (a * b).sum(1)
    most = (a * a).sum(1) + (b * b).sum(1) - both
    near = np.clip(np.divide(both, most, out=np.zeros(len(a)), where=most > 0), 0.0, 1.0)
    return np.where((x == y).all(1), 1.0, near)


def half_lengths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, and positions of all first bytes of code points."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    return np.diff(np.searchsorted(leads, offsets)), leads


def edited(column: pa.Array, following: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Code points of each text; each with its last half replaced by as much of the next text's beginning."""
    data, at = utf8(column)
    other, other_at = utf8(following)
    counts, leads = half_lengths(data, at)
    other_counts, other_leads = half_lengths(other, other_at)
    first = np.searchsorted(leads, at[:-1])
    other_first = np.searchsorted(other_leads, other_at[:-1])
    raw, other_raw = data.tobytes(), other.tobytes()
    out = []
    for i, n in enumerate(counts):
        half = int(n) // 2
        keep = int(n) - half
        end = int(leads[first[i] + keep]) if half else int(at[i + 1])
        take = min(half, int(other_counts[i]))
        if take < other_counts[i]:
            stop = int(other_leads[other_first[i] + take])
        else:
            stop = int(other_at[i + 1])
        out.append(raw[at[i] : end] + other_raw[other_at[i] : stop])
    return counts, out


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every text, and its edited text, made with the next document's beginning.

    The next document is the one with the next lower doc_id (after the lowest:
    the highest).  Documents are dealt into ``parts`` runs in that order (eight
    times spark.sql.shuffle.partitions, which Spark puts together by size); the first
    document of each run also goes to the run before, so that no run needs more
    than itself.  Runs are sorted by Spark, which spills, and streamed: a worker
    holds one batch.  Null texts count as empty; a null doc_id comes after all
    others; rows that repeat a doc_id stand in the order of their texts' hashes; a
    table of one row follows itself; an empty table gives an empty result.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("_k")
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.xxhash64(text).alias("_t")
    order = [F.col("_k").desc(), F.col("_t")]
    # Equal (id, text) share a run; one id may fill many.
    ranges = docs.select(key, tie).repartitionByRange(parts, *order)
    first = F.max(F.struct("_k", F.bitwise_not("_t").alias("_u"))).alias("_f")
    tops = ranges.groupBy(F.spark_partition_id()).agg(first).select("_f.*").collect()
    # The first rows of the runs, in order.
    tops = sorted((-int(k), -int(u)) for k, u in tops)

    def dealt(ids: pd.Series, ties: pd.Series) -> pd.Series:
        rows = [(-k, t + 1) for k, t in zip(ids.tolist(), ties.tolist(), strict=True)]  # -(~t) is t + 1
        part = [bisect_right(tops, row) - 1 for row in rows]
        return pd.Series([[p, (p - 1) % len(tops)] if tops[p] == row else [p] for p, row in zip(part, rows, strict=True)])

    rows = docs.select(key, tie, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("*", F.posexplode(F.pandas_udf(dealt, "array<int>")("_k", "_t")).alias("_lent", "_part"))
    rows = rows.repartition("_part").sortWithinPartitions("_part", "_lent", *order)

    def run(batches):
        """Each row with the one behind it; lent rows end their run and are no rows of it."""
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            column = batch.column("text")
            _, offsets = utf8(column)
            own = np.array(batch.column("_lent").to_pylist()) == 0
            for i, j in blocks(offsets[:-1]):
                some = np.flatnonzero(own[i:j]) + i
                if len(some):
                    yield _described(batch.column("doc_id").take(pa.array(some)), column.slice(i, j - i + 1), some - i)
            held = batch.slice(batch.num_rows - 1)
        release_memory()

    return rows.select("_lent", "doc_id", "text").mapInArrow(run, _SCHEMA)


def _described(ids: pa.Array, texts: pa.Array, own: np.ndarray) -> pa.RecordBatch:
    """Rows of the result for the texts at ``own``, each followed by the next text."""
    prints = fingerprint_array(*utf8(texts))
    mine, after = prints[own], prints[own + 1]
    counts, changed = edited(texts.take(pa.array(own)), texts.take(pa.array(own + 1)))
    lengths = np.cumsum([0, *map(len, changed)])
    new = fingerprint_array(np.frombuffer(b"".join(changed), np.uint8), lengths)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
         pa.array(text_form(mine)), pa.array(text_form(new)), pa.array(likeness(mine, new)), pa.array(likeness(mine, after))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
