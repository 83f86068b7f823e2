"""Sharding by Hilbert-curve order (DataFrame functions only).

Each document becomes a point in a grid of metadata (language, source, size);
documents are put in the order of a Hilbert curve through that grid and the
order is cut into runs.  Neighbours on the curve are neighbours in every
dimension, so each shard spans a small box of the grid and a reader that filters
on several dimensions at once skips most shards.

Copies of one text take the place of their first copy (lowest doc_id), so they
stand next to each other on the curve, whatever their own source is.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.ranks import running_sum
from colonnade.llm.work import cut, text_name

#: Bits of each dimension of the grid.
BITS = 4
#: Parts of a cell of the grid: by text, and inside a text by document.
TEXT_PARTS, DOC_PARTS = 64, 64


def hilbert_position(point: tuple[int, ...], bits: int) -> int:
    """Index of a grid point along the Hilbert curve, from its Gray-code definition.

    The cube is halved once per level; ``corner`` and ``axis`` say how the
    curve enters the sub-cube and along which axis it leaves.
    """
    n = len(point)
    full = (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & full

    def ones_at_end(x: int) -> int:
        count = 0
        while x & 1:
            x >>= 1
            count += 1
        return count

    index, corner, axis = 0, 0, 0
    for level in range(bits - 1, -1, -1):
        half = sum(((c >> level) & 1) << k for k, c in enumerate(point))
        gray = turn(half ^ corner, n - (axis + 1) % n)
        place = gray
        shift = 1
        while shift < n:
            place ^= place >> shift
            shift <<= 1
        index = (index << n) | place
        if place:
            even = 2 * ((place - 1) // 2)
            entry = even ^ (even >> 1)
            leave = ones_at_end(place if place & 1 else place - 1) % n
        else:
            entry, leave = 0, 0
        corner ^= turn(entry, axis + 1)
        axis = (axis + leave + 1) % n
    return index


@lru_cache(maxsize=8)
def curve_table(dims: int, bits: int) -> tuple[int, ...]:
    """Curve index of every cell, cells numbered with the first dimension as the highest digits."""
    side = 1 << bits
    cells = [()]
    for _ in range(dims):
        cells = [(*c, k) for c in cells for k in range(side)]
    return tuple(hilbert_position(c, bits) for c in cells)


def hilbert_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put every row into one of ``shards`` runs of the curve; row counts differ by one at most.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard
    (null), curve_index, lang, source.  Null texts count as empty, null lang and
    source are values of their own; repeated rows keep a row each; an empty table
    gives an empty result.  Other columns are ignored.

    No text is shuffled: the first projection reduces a row to its metadata.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[c.alias(n) for n, c in text_name(text).items()],
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    meta = cut(narrow, "shard-metadata")  # the texts are read once
    first = meta.groupBy("_a", "_b").agg(F.min(F.struct("doc_id", "lang", "source")).alias("_first"))
    side = 1 << BITS
    # Values in their order, null first; where there are more than the side has places, neighbours share one.
    for name in ("lang", "source"):
        known = meta.select(F.col(name).alias("_v")).distinct()
        rank = F.row_number().over(Window.orderBy(F.col("_v").asc_nulls_first())) - 1
        number = F.count(F.lit(1)).over(Window.partitionBy())
        place = F.when(F.col("_n") <= side, F.col("_r")).otherwise(F.expr(f"_r * {side} div _n")).cast("int").alias(f"_{name}")
        known = known.withColumns({"_r": rank, "_n": number}).select("_v", place)
        first = first.join(known, F.col(f"_first.{name}").eqNullSafe(F.col("_v")), "left").drop("_v")

    scale = F.least(F.floor(F.log2("size")), F.lit(side - 1)).cast("int")
    table = F.from_json(F.lit(str(list(curve_table(3, BITS)))), "array<int>")
    cell = (F.col("_lang") * side + F.col("_source")) * side + scale
    placed = meta.join(first, ["_a", "_b"]).select(
        "doc_id", "size", "text_crc32", "lang", "source", "_a", "_b",
        F.get(table, cell).alias("curve_index"),
        F.lit(1).cast("long").alias("_one"),
        (
            F.pmod(F.col("_a"), F.lit(TEXT_PARTS)) * DOC_PARTS
            + F.pmod(F.xxhash64("doc_id"), F.lit(DOC_PARTS))
        ).alias("_part"),
    )
    ranked = running_sum(
        placed, [], ["curve_index", "_part"], ["_a", "_b", "doc_id"], "_one", "_rank"
    )
    total = meta.agg(F.count(F.lit(1)).alias("_rows"))
    # Shard s holds the ranks from floor(s * n / shards) on.
    return (
        ranked.withColumn("_rows", total.scalar())
        .withColumn("_s", F.expr(f"((_rank + 1) * {shards} - 1) div _rows"))
        .select(
            "doc_id", "size", "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_s").cast("int").alias("shard"),
            (F.col("_rank") - F.expr(f"(_s * _rows) div {shards}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve_index", "lang", "source",
        )
    )
