"""Content-addressed store of token ids.

Files, below one folder of the shared store, all Parquet with zstandard:

``chunks``   digest (SHA-256 of payload), payload (ids, little-endian, ``width`` bytes each): every distinct chunk once.
``recipes``  in ascending doc_id order: doc_id, start (ids of all documents before it), n_tokens, digests, lengths, and
             root: the Merkle root over the digests.
``manifest`` a row for each part of the recipes: its first start, ids, documents, and a digest of its roots.

A gear rolling hash over the ids cuts chunks, so equal passages give equal chunks wherever they stand. Each task drops
chunks that it has itself seen; what is still there twice is found from digests alone and left out of the second write,
so payloads are never shuffled. Reading checks each stored chunk once against its digest, each recipe against its root,
and derives document checksums from chunk checksums: CRC-32 is linear, so a chunk's share in the document's checksum is
its own, moved by the bytes after it, and shares combine by exclusive or, in any order.

Defined cases: null and empty text are the end id alone; very long texts make many chunks; an id too great for ``width``
is refused, never cut; of rows that share a doc_id each keeps its own recipe, ordered
by root; rows without doc_id come first; an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder, slices, tokenizer_path, trim
from .work import discard, prepare, spool, work_dir, write

END_ID = 2
#: Known words in each worker, about 170 bytes each.
MEMO_PIECES = 1_000_000
WINDOW = 32
LEAST, MEAN, MOST = 256, 1024, 4096
#: The redundant chunks are left out by a broadcast up to so many rows (48 bytes each), beyond by a shuffled join.
BROADCAST_ROWS = 500_000
#: A task forgets the digests that it has seen beyond so many; the global step finds their copies.
SEEN = 1_000_000


@lru_cache(1)
def _gear(size: int = 1 << 16) -> np.ndarray:
    """A pseudo-random 32-bit value for each id, and 0 for the gap between documents."""
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.append((x >> np.uint64(32)).astype(np.uint32), np.uint32(0))


def cut_points(docs: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id array. A cut depends on the WINDOW ids before it and on the last cut only."""
    gear = _gear()
    gap = np.full(WINDOW, len(gear) - 1, dtype=np.int64)
    joined = np.concatenate([x for d in docs for x in (d % (len(gear) - 1), gap)])
    h = gear[joined]
    width = 1
    while width < WINDOW:  # h[i] = sum of gear[i - k] << k over the window, by doubling
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    hits = np.flatnonzero((h >> np.uint32(32 - (MEAN - 1).bit_length())) == 0)
    out, base = [], 0
    for d in docs:
        ends, last = [], 0
        a, b = np.searchsorted(hits, (base, base + len(d)))
        for end in (hits[a:b] - base + 1).tolist():
            while end - last > MOST:
                last += MOST
                ends.append(last)
            if end - last >= LEAST:
                ends.append(end)
                last = end
        while len(d) - last > MOST:
            last += MOST
            ends.append(last)
        if last < len(d):
            ends.append(len(d))
        out.append(ends)
        base += len(d) + WINDOW
    return out


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairwise SHA-256 up to one node; an odd node moves up as it is."""
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, width: int) -> DataFrame:
    """Rows of two kinds: recipes (digests set) and chunks that the task hasn't seen (payload set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path, True, MEMO_PIECES), set()
        tail = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, most_bytes=4 << 20):
                ids = [np.frombuffer(b + tail, "<u4") for b in enc.encode(batch.column(1))]
                if width < 4 and any(x.max() >> (8 * width) for x in ids):
                    raise ValueError(f"an id does not fit into {width} bytes")
                digests, lengths, roots, new, payloads = [], [], [], [], []
                for x, ends in zip(ids, cut_points([x.astype(np.int64) for x in ids])):
                    data, own, sizes, last = x.astype(f"<u{width}").tobytes(), [], [], 0
                    for end in ends:
                        chunk = data[last * width : end * width]
                        digest = hashlib.sha256(chunk).digest()
                        own.append(digest)
                        sizes.append(end - last)
                        last = end
                        if digest not in seen:
                            seen.add(digest)
                            new.append(digest)
                            payloads.append(chunk)
                    digests.append(own)
                    lengths.append(sizes)
                    roots.append(merkle_root(own))
                if len(seen) > SEEN:
                    seen.clear()
                none = lambda t: pa.nulls(len(new), t)
                pair = lambda a, b, t: pa.concat_arrays([pa.array(a, t) if isinstance(a, list) else a.cast(t), b if isinstance(b, pa.Array) else pa.array(b, t)])
                kind = batch.column(0).type
                yield pa.RecordBatch.from_arrays(
                    [
                        pair(batch.column(0), none(kind), kind),
                        pair([len(x) for x in ids], none(pa.int64()), pa.int64()),
                        pair(digests, none(pa.list_(pa.binary())), pa.list_(pa.binary())),
                        pair(lengths, none(pa.list_(pa.int32())), pa.list_(pa.int32())),
                        pair(roots, none(pa.binary()), pa.binary()),
                        pair([None] * len(ids), new, pa.binary()),
                        pair([None] * len(ids), payloads, pa.binary()),
                    ],
                    names=names,
                )
        trim()

    names = ["doc_id", "n_tokens", "digests", "lengths", "root", "digest", "payload"]
    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {key}, n_tokens long, digests array<binary>, lengths array<int>, root binary, digest binary, payload binary")


def write_store(docs: DataFrame, folder: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2) -> str:
    """Encode whole texts, append the end id, write the store. Returns its folder. ``width`` 2 holds ids below 65,536."""
    spark = prepare(docs.sparkSession)
    folder = folder or work_dir(spark)
    plain = {"parquet.enable.dictionary": "false"}
    rows = spool(_encoded(docs, path or tokenizer_path("byte_bpe_50k.json"), id_col, text_col, end_id, width).withColumn("at", F.monotonically_increasing_id()), **plain, compression="snappy")

    new = rows.where("payload IS NOT NULL").select("digest", "at")
    owners = new.groupBy("digest").agg(F.min("at").alias("own"), F.count("*").alias("n")).where("n > 1")
    spare = spool(new.join(owners, "digest").where("at <> own").select("at"))
    few = spare.count() <= BROADCAST_ROWS
    chunks = rows.where("payload IS NOT NULL").join(F.broadcast(spare) if few else spare, "at", "left_anti")
    chunks.select("digest", "payload").write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").options(**plain).parquet(f"{folder}/chunks")

    recipes = rows.where("digests IS NOT NULL").select("doc_id", "n_tokens", "digests", "lengths", "root")
    dealt = spool(recipes.repartitionByRange("doc_id", "root").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("documents"))
    # As many rows as the recipes have parts, whatever their size.
    manifest = write(parts.withColumn("first", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), f"{folder}/manifest")
    before = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    ordered = dealt.join(F.broadcast(manifest.select("part", "first")), "part")
    ordered = ordered.withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    ordered.select("doc_id", "start", "n_tokens", "digests", "lengths", "root", "part").sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    discard(rows, spare, dealt)
    return folder


@lru_cache(1)
def _shifts() -> list[np.ndarray]:
    """For each j a table: CRC-32 registers moved by 2**j zero bytes, by byte of the register."""
    step = np.array([zlib.crc32(b"\0", 0xFFFFFFFF ^ (1 << k)) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for k in range(32)], dtype=np.uint32)
    out = []
    for _ in range(48):
        table = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for bit in range(8):
                v = np.arange(256)
                table[byte][(v >> bit) & 1 == 1] ^= step[8 * byte + bit]
        out.append(table)
        step = _moved(step, table)
    return out


def _moved(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def crc_share(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What pieces with these checksums, followed by so many bytes, add to the checksum of the whole."""
    x = crc.astype(np.uint32)
    for j, table in enumerate(_shifts()):
        on = (after >> j) & 1 == 1
        if not on.any() and not (after >> j).any():
            break
        x[on] = _moved(x[on], table)
    return x


def read_checks(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Read the store back: doc_id, start, n_tokens, ids_crc32 (of the ids as uint32), n_chunks, verified."""
    prepare(spark)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            crc = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in data]
            good = [hashlib.sha256(p).digest() == d for d, p in zip(b.column(0).to_pylist(), data)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array([len(p) // width for p in data], pa.int64()), pa.array(good, pa.bool_())], names=["digest", "crc", "n", "good"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (digests, lengths, root, n) in enumerate(zip(*(b.column(k).to_pylist() for k in ("digests", "lengths", "root", "n_tokens")))):
                left, whole = 4 * n, merkle_root(digests) == root
                for digest, length in zip(digests, lengths):
                    left -= 4 * length
                    rows.append((i, digest, length, left, whole))
            at, *cols = zip(*rows) if rows else ([],) * 5
            take = pa.array(at, pa.int64())
            types = (pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in ("doc_id", "start", "n_tokens")), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "start", "n_tokens", "digest", "length", "after", "whole"])

    @F.pandas_udf("long")
    def share(crc, after):
        import pandas as pd

        return pd.Series(crc_share(crc.to_numpy().astype(np.int64), after.to_numpy().astype(np.int64)).astype(np.int64))

    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "payload").mapInArrow(checked, "digest binary, crc long, n long, good boolean")
    recipes = spark.read.parquet(f"{folder}/recipes")
    key = recipes.schema["doc_id"].dataType.simpleString()
    wanted = recipes.select("doc_id", "start", "n_tokens", "digests", "lengths", "root").mapInArrow(listed, f"doc_id {key}, start long, n_tokens long, digest binary, length long, after long, whole boolean")
    rows = wanted.join(chunks, "digest", "left")
    rows = rows.withColumn("share", share(F.coalesce("crc", F.lit(0)), "after")).withColumn("ok", F.col("whole") & F.coalesce(F.col("good") & (F.col("n") == F.col("length")), F.lit(False)))
    return rows.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.bool_and("ok").alias("verified"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids: the documents, put together from recipes and chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "start", F.posexplode("digests").alias("seq", "digest"))
    rows = recipes.join(spark.read.parquet(f"{folder}/chunks"), "digest")
    rows = rows.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("rows"))
    return rows.select("doc_id", "start", F.aggregate("rows", F.lit(b"").cast("binary"), lambda out, r: F.concat(out, r["payload"])).alias("ids"))
