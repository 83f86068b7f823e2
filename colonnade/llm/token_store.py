"""Content-addressed store of token ids.

Layout under one folder::

    data/kind=chunk     key (digest), payload: ids as little-endian uint16 or uint32; each digest once
    data/kind=recipe    key (row), doc_id, n_tokens, payload: the digests of the document's chunks
    recipes             doc_id order: part, seq, doc_id, n_tokens, local_start, digests, leaf
    manifest            part, n_docs, n_tokens, start, root, store_root, width

A rolling hash over the last WINDOW ids cuts a document's ids into chunks, so
equal passages give equal chunks wherever they stand.  A document's leaf hashes
its id, length and digests; a node of the Merkle tree hashes up to FAN nodes
below it, a part's root stands over the leaves of the part, and the store's root
over those of the parts.  Ids take ``width`` bytes: two where the vocabulary
allows it, else four.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.llm.bytebpe import encoder, texts_of
from colonnade.llm.text import blocks, mix, utf8
from colonnade.llm.work import fresh_path, release_memory

#: Ids in the rolling hash; mean and largest ids of a chunk.
WINDOW, MEAN, LARGEST = 16, 512, 4096
DIGEST = 16
#: Nodes under one node of the Merkle tree.
FAN = 256
#: Texts encoded at once, in bytes.
TEXT_BLOCK = 1 << 19


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1 << 17, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


def chunk_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of all chunks, document of each), for documents' ids end to end."""
    n = len(ids)
    stop = np.cumsum(counts)
    begin = stop - counts
    with np.errstate(over="ignore"):
        h = _gear()[ids.astype(np.int64) & ((1 << 17) - 1)]
        step = 1
        while step < WINDOW:
            h[step:] = h[step:] + (h[:-step] << np.uint64(step))
            step *= 2
        h = mix(h)
    cut = np.flatnonzero((h & np.uint64(MEAN - 1)) == 0)
    owner = np.searchsorted(stop, cut, "right")
    cut = cut[cut - begin[owner] >= WINDOW - 1] + 1  # whole windows only
    ends = np.union1d(cut, stop[counts > 0]) if n else np.zeros(0, np.int64)
    if not n:
        return ends, ends
    size = np.diff(ends, prepend=0)
    long = np.flatnonzero(size > LARGEST)
    if len(long):
        more = [np.arange(ends[k] - size[k] + LARGEST, ends[k], LARGEST) for k in long]
        ends = np.union1d(ends, np.concatenate(more))
    return ends, np.searchsorted(stop, ends, "left")


def leaf(doc_id: int | None, n_tokens: int, digests: bytes) -> bytes:
    name = b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True)
    return hashlib.sha256(b"\x00" + name + n_tokens.to_bytes(8, "little") + digests).digest()


_DATA = "kind string, key binary, doc_id long, n_tokens long, payload binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every text, append ``end_id``, and write the store.

    Null texts count as empty (the end id alone); repeated rows are documents of
    their own, in the order of their place; a null doc_id stands first; an empty
    table gives an empty store.  Other columns are ignored.  Raises where the
    vocabulary does not hold ``end_id``.
    """
    spark = docs.sparkSession
    if not 0 <= end_id < len(encoder(tokenizer_path).spaced):
        raise ValueError(f"no such id in the vocabulary: {end_id}")

    def run(batches):
        own = encoder(tokenizer_path)
        little = own.kind.newbyteorder("<")
        width = own.kind.itemsize
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            seen: set[bytes] = set()
            for i, j in blocks(offsets, TEXT_BLOCK):
                keys = batch.column(0).slice(i, j - i).to_pylist()
                names = batch.column(1).slice(i, j - i).to_pylist()
                ids, counts = own.encode(texts_of(batch.column(2).slice(i, j - i)))
                whole = np.full(len(ids) + j - i, end_id, own.kind)
                stop = np.cumsum(counts + 1)
                keep = np.ones(len(whole), bool)
                keep[stop - 1] = False
                whole[keep] = ids
                ends, owner = chunk_ends(whole, counts + 1)
                raw = whole.astype(little).tobytes()
                rows: list[tuple] = []
                digests: list[list[bytes]] = [[] for _ in range(j - i)]
                at = 0
                for end, of in zip(ends.tolist(), owner.tolist(), strict=True):
                    chunk = raw[width * at : width * end]
                    at = end
                    name = hashlib.blake2b(chunk, digest_size=DIGEST).digest()
                    digests[of].append(name)
                    if name not in seen:
                        seen.add(name)
                        rows.append(("chunk", name, None, None, chunk))
                for d in range(j - i):
                    row = b"r" + keys[d].to_bytes(8, "big", signed=True)
                    rows.append(("recipe", row, names[d], int(counts[d]) + 1, b"".join(digests[d])))
                kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "doc_id", "n_tokens", "payload"])
        release_memory()

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    ).mapInArrow(run, _DATA)
    # One shuffle brings copies of a chunk together and deals the recipes out.
    once = rows.groupBy("kind", "key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("payload").alias("payload")
    )
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")

    recipes = _data(spark, path, "recipe").select("doc_id", "n_tokens", F.col("payload").alias("digests"), "key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "key")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
        .withColumn("part", F.spark_partition_id())
    )

    def number(batches):
        seq, start = 0, 0
        for batch in batches:
            names, sizes, digests, _, part = (c.to_pylist() for c in batch.columns)
            starts = start + np.cumsum([0, *sizes])
            leaves = [leaf(*x) for x in zip(names, sizes, digests, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(range(seq, seq + len(names)), pa.int64()),
                 pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(starts[:-1], pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(leaves, pa.binary())],
                ["part", "seq", "doc_id", "n_tokens", "local_start", "digests", "leaf"],
            )
            seq, start = seq + len(names), int(starts[-1])

    ordered.mapInArrow(
        number,
        "part int, seq long, doc_id long, n_tokens long, local_start long, digests binary, leaf binary",
    ).write.option("compression", "zstd").parquet(f"{path}/recipes")
    width = F.lit(encoder(tokenizer_path).kind.itemsize).alias("width")
    _manifest(_read(spark, path, "recipes")).select("*", width).write.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    schemas = {
        "recipes": "part int, seq long, doc_id long, n_tokens long, local_start long, digests binary, leaf binary",
        "manifest": "part int, n_docs long, n_tokens long, start long, root binary, store_root binary, width int",
    }
    return spark.read.schema(schemas[name]).parquet(f"{path}/{name}")


def _data(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_DATA).option("basePath", f"{path}/data").parquet(f"{path}/data").filter(F.col("kind") == kind)


def _over(nodes: DataFrame, keys: list[str], to: str) -> DataFrame:
    """One node for each ``keys``, over up to FAN nodes (_at, _node) in the order of _at."""
    below = F.sort_array(F.collect_list(F.struct("_at", "_node")))
    joined = F.concat(F.lit(b"\x01"), F.unhex(F.array_join(F.transform(below, lambda x: F.hex(x["_node"])), "")))
    return nodes.groupBy(*keys).agg(F.unhex(F.sha2(joined, 256)).alias(to))


def _roots(nodes: DataFrame, count: int) -> DataFrame:
    """(part, root) of nodes (part, _at, _node), ``count`` in a part at most; FAN nodes meet in one row, never a part."""
    while count > FAN:
        above = _over(nodes.withColumn("_up", F.expr(f"_at div {FAN}")), ["part", "_up"], "_node")
        nodes, count = above.withColumnRenamed("_up", "_at"), -(-count // FAN)
    return _over(nodes, ["part"], "root")


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row for each part, in doc_id order: n_docs, n_tokens, start, root, store_root."""
    parts = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    largest, number = parts.agg(F.max("n_docs"), F.max("part") + 1).first()
    leaves = recipes.select("part", F.col("seq").alias("_at"), F.col("leaf").alias("_node"))
    parts = parts.join(_roots(leaves, largest or 0), "part")
    # From here on there is one row a part.
    tops = parts.select(F.lit(0).alias("part"), F.col("part").cast("long").alias("_at"), F.col("root").alias("_node"))
    top = _roots(tops, number or 0).select("root").scalar().alias("store_root")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    return parts.select("part", "n_docs", "n_tokens", start, "root", top)


def store_root(spark: SparkSession, path: str) -> str | None:
    """Merkle root of the whole store, None if it is empty."""
    found = _read(spark, path, "manifest").select("store_root").first()
    return bytes(found[0]).hex() if found else None


def _width(spark: SparkSession, path: str) -> int:
    found = _read(spark, path, "manifest").select("width").first()
    return found[0] if found else 2


@lru_cache(maxsize=1)
def _zero_bytes() -> np.ndarray:
    """tables[k, j, b]: what byte j = b of a CRC-32 becomes after 2**k zero bytes."""

    def through(matrix: np.ndarray, x: int) -> int:
        out, k = 0, 0
        while x:
            if x & 1:
                out ^= int(matrix[k])
            x >>= 1
            k += 1
        return out

    # One zero bit, then squared three times for a byte.
    matrix = np.array([0xEDB88320, *[1 << k for k in range(31)]], np.uint64)
    for _ in range(3):
        matrix = np.array([through(matrix, int(c)) for c in matrix], np.uint64)
    tables = np.zeros((40, 4, 256), np.uint32)
    for level in range(40):
        for j in range(4):
            for b in range(256):
                tables[level, j, b] = through(matrix, b << (8 * j))
        matrix = np.array([through(matrix, int(c)) for c in matrix], np.uint64)
    return tables


def crc_of_pieces(crcs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of texts from those of their consecutive pieces; texts begin at ``first``."""
    if not len(crcs):
        return np.zeros(0, np.uint32)
    total = np.cumsum(sizes)
    last = np.append(first[1:], len(crcs)) - 1
    after = np.repeat(total[last], np.diff(np.append(first, len(crcs)))) - total
    moved = crcs.astype(np.uint32)
    tables = _zero_bytes()
    for level in range(int(after.max()).bit_length()):
        some = np.flatnonzero((after >> level) & 1)
        x = moved[some]
        t = tables[level]
        moved[some] = t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]
    return np.bitwise_xor.reduceat(moved, first)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, verified.

    Every chunk is read and its digest recomputed; a document's CRC-32 (of its
    ids as uint32) is put together from those of its chunks.  ``verified``: all
    chunks are there and whole, the Merkle leaf is that of the recipe, and the
    manifest's row of the part and its store root are those of the leaves.
    """
    width = _width(spark, path)

    def weigh(batches):
        for batch in batches:
            keys, chunks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crcs = [zlib.crc32(np.frombuffer(c, f"<u{width}").astype("<u4").tobytes()) for c in chunks]
            whole = [hashlib.blake2b(c, digest_size=DIGEST).digest() == k for k, c in zip(keys, chunks, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(c) // width for c in chunks], pa.int32()),
                 pa.array(crcs, pa.int64()), pa.array(whole, pa.bool_())],
                ["digest", "n", "crc", "whole"],
            )
        release_memory()

    chunks = _data(spark, path, "chunk").select("key", "payload")
    chunks = chunks.mapInArrow(weigh, "digest binary, n int, crc long, whole boolean")
    recipes = _read(spark, path, "recipes")
    place = F.posexplode(F.expr(f"transform(sequence(0, octet_length(digests) div {DIGEST} - 1), "
                                f"i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("pos", "digest")  # fmt: skip
    used = recipes.select("part", "seq", place).join(chunks, "digest", "left")
    found = used.groupBy("part", "seq").agg(
        F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("pieces"),
        F.every(F.coalesce("whole", F.lit(False))).alias("whole"),
    )
    kept, again = _read(spark, path, "manifest").drop("width"), _manifest(recipes)
    same = [kept[c] == again[c] for c in kept.columns]
    sound = F.coalesce(reduce(Column.__and__, same[1:]), F.lit(False)).alias("sound")
    # One row a part.
    starts = kept.join(again, same[0], "left").select(kept["part"], kept["start"], sound)
    joined = recipes.join(found, ["part", "seq"]).join(starts, "part")
    joined = joined.select(
        "doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "digests", "leaf",
        (F.col("whole") & F.col("sound")).alias("whole"), F.col("pieces.n").alias("n"), F.col("pieces.crc").alias("crc"),
    )

    def finish(batches):
        for batch in batches:
            names, starts, sizes, digests, leaves, whole, n, crc = (c.to_pylist() for c in batch.columns)
            first = np.cumsum([0, *map(len, n)])[:-1]
            pieces = np.array([x or 0 for xs in n for x in xs], np.int64)
            sums = np.array([x or 0 for xs in crc for x in xs], np.int64)
            crcs = crc_of_pieces(sums, 4 * pieces, first)
            good = [
                w and sum(k or 0 for k in own) == size and leaf(name, size, d) == mark
                for w, own, size, name, d, mark in zip(whole, n, sizes, names, digests, leaves, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(crcs.astype(np.int64)), pa.array(good, pa.bool_())],
                ["doc_id", "start", "n_tokens", "ids_crc32", "verified"],
            )

    return joined.mapInArrow(finish, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, put together from its chunks."""
    width = _width(spark, path)
    recipes = _read(spark, path, "recipes")
    place = F.posexplode(F.expr(f"transform(sequence(0, octet_length(digests) div {DIGEST} - 1), "
                                f"i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("pos", "key")  # fmt: skip
    chunks = _data(spark, path, "chunk").select("key", "payload")
    used = recipes.select("part", "seq", place).join(chunks, "key")
    whole = used.groupBy("part", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("p"))
    starts = _read(spark, path, "manifest").select("part", "start")
    joined = recipes.join(whole, ["part", "seq"]).join(starts, "part").select(
        "doc_id", (F.col("start") + F.col("local_start")).alias("start"), F.col("p.payload").alias("p")
    )

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), f"<u{width}").astype(np.int32) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"]
            )

    return joined.mapInArrow(run, "doc_id long, start long, ids array<int>")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write a store (in the shared folder unless ``path`` is given) and read its summary back."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-store")
    write_store(docs, path, tokenizer_path)
    return read_summary(spark, path)
