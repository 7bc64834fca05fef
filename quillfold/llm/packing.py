"""Packing by cutting-stock column generation.

Documents are encoded once; each becomes full pieces of ``capacity`` ids and a remainder. Remainder lengths, rounded up
to a grain, form a histogram. A linear program over patterns (how many pieces of each class share a sequence) is solved
by column generation: the simplex duals price the classes, a knapsack dynamic program finds the best new pattern, until
none helps. The solution is rounded down, its patterns are laid out over the ranks of each class, and the few pieces
left over (fewer than one pattern's worth for each pattern) are placed best fit first at their true lengths.

Nothing but the histogram reaches the driver: at most ``capacity / grain`` counts. Pieces find their sequence from
(class, rank) alone, ranks being numbered within input partitions and shifted by per-partition counts, so a class that
holds most pieces is never gathered.

Defined cases: null and empty text are the end id alone; repeated rows are packed as often as they occur; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder, slices, tokenizer_path, trim
from .work import prepare, spool

END_ID = 1
#: Known words in each worker, about 170 bytes each: packing ends a pipeline whose other stages also hold memory.
MEMO_PIECES = 300_000


@dataclass(frozen=True)
class Packed:
    """``pieces``: the spooled pieces with their ids (little-endian uint32); ``placed``: a row for each piece, without ids."""

    pieces: DataFrame
    placed: DataFrame


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = 2048, grain: int = 16) -> DataFrame:
    """doc_id, start, length, doc_tokens, cls, part, rank, ids: rank numbers the pieces of a class within an input partition."""
    key_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ranks = encoder(path, False, MEMO_PIECES), TaskContext.get().partitionId(), {}
        tail = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole):
                keys, rows = batch.column(0), []
                for i, ids in enumerate(enc.encode(batch.column(1))):
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        cls = -(-length // grain)
                        rank = ranks[cls] = ranks.get(cls, -1) + 1
                        rows.append((i, start, length, n, cls, part, rank, ids[4 * start : 4 * (start + length)]))
                at, *cols = zip(*rows)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)
        trim()

    names = ["doc_id", "start", "length", "doc_tokens", "cls", "part", "rank", "ids"]
    schema = f"doc_id {key_type}, start long, length long, doc_tokens long, cls int, part int, rank long, ids binary"
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the dearest multiset of classes that fits the room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    by_size = np.full(room + 1, -1.0)
    by_size[sizes] = prices
    for c in range(1, room + 1):
        gain = by_size[1 : c + 1] + best[c - 1 :: -1] if c > 1 else by_size[1:2] + best[:1]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], took[c] = gain[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c, where = np.zeros(len(sizes)), room, {int(s): i for i, s in enumerate(sizes)}
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[where[int(took[c])]] += 1
            c -= int(took[c])
    return float(best[room]), pattern


def solve(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = 4000) -> list[tuple[float, np.ndarray]]:
    """Column generation by the revised simplex method: (how often, pattern) for the basic patterns.

    ``rounds`` bounds the work; the patterns in the basis cover the counts after any number of rounds.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse, x = np.diag(1.0 / np.diag(basis)), counts / np.diag(basis)
    for _ in range(rounds):
        value, column = best_pattern(np.maximum(inverse.sum(axis=0), 0), sizes, room)
        if value <= 1 + 1e-7:
            break
        step = np.einsum("ij,j->i", inverse, column)  # small; threads of a linear algebra library would only wait for cores
        up = step > 1e-10
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(float(x[j]), basis[:, j]) for j in range(m) if x[j] > 1e-9]


def lay_out(lengths: dict[int, int], capacity: int, grain: int) -> list[tuple[int, int, int, int, int, int]]:
    """From piece counts by class: rows (cls, first rank, last rank, a, first sequence, first slot).

    The piece of that class and rank r goes to sequence ``first sequence + (r - first rank) // a``. Rows are bounded by
    the patterns of the basis and the pieces left after rounding, neither of which grows with the corpus.
    """
    if not lengths:
        return []
    room, sizes = capacity // grain, np.array(sorted(lengths))
    counts = np.array([lengths[int(s)] for s in sizes], dtype=float)
    used, rows, sequence = dict.fromkeys(lengths, 0), [], 0
    for often, pattern in sorted(solve(sizes, counts, room), key=lambda p: -p[0]):
        held = {int(s): int(round(a)) for s, a in zip(sizes, pattern) if a > 0.5}
        times = min([int(often + 1e-6), *((lengths[s] - used[s]) // a for s, a in held.items())])
        if times < 1:
            continue
        slot = 0
        for s in sorted(held, reverse=True):
            a = held[s]
            rows.append((s, used[s], used[s] + a * times - 1, a, sequence, slot))
            used[s] += a * times
            slot += a
        sequence += times
    free: dict[int, list[int]] = {}  # by room left: sequences; best fit, longest class first
    slots: dict[int, int] = {}
    for s in sorted(lengths, reverse=True):
        for rank in range(used[s], lengths[s]):
            fits = [r for r in free if r >= s and free[r]]
            if fits:
                r = min(fits)
                q = free[r].pop()
            else:
                r, q = room, sequence
                sequence += 1
            slot = slots.get(q, 0)
            slots[q] = slot + 1
            rows.append((s, rank, rank, 1, q, slot))
            if r > s:
                free.setdefault(r - s, []).append(q)
    return rows


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = 2048, grain: int = 16) -> Packed:
    """Pack all documents into sequences of at most ``capacity`` ids.

    ``placed`` has doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset.
    """
    spark = prepare(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")
    pieces = spool(cut_pieces(docs, path, id_col, text_col, end_id, capacity, grain), **{"parquet.enable.dictionary": "false"})
    counts = spool(pieces.groupBy("part", "cls").agg(F.count("*").alias("n")))
    lengths = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most capacity / grain rows
    slots = spark.createDataFrame(lay_out(lengths, capacity, grain), "cls int, lo long, hi long, a long, sequence long, slot long")
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.select("doc_id", "start", "length", "doc_tokens", "cls", "part", "rank", F.crc32("ids").alias("ids_crc32")).join(shifts, ["part", "cls"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "part")
    step = F.col("rank") - F.col("lo")
    seated = ranked.join(F.broadcast(slots), "cls").where((F.col("rank") >= F.col("lo")) & (F.col("rank") <= F.col("hi")))
    seated = seated.withColumn("sequence_id", F.col("sequence") + F.floor(step / F.col("a"))).withColumn("seat", F.col("slot") + F.pmod(step, F.col("a")))
    ahead = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    return Packed(pieces, seated.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset")))


def sequences(packed: Packed) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, unpadded; each holds at most ``capacity`` ids."""
    ids = packed.pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids").dropDuplicates(["doc_id", "start", "length", "ids_crc32"])
    keys = ["doc_id", "start", "length", "ids_crc32"]
    same = [packed.placed[k].eqNullSafe(ids[k]) for k in keys]
    rows = packed.placed.join(ids, same).select("sequence_id", "offset", "ids")
    joined = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return joined.select("sequence_id", F.aggregate("rows", F.lit(b"").cast("binary"), lambda out, r: F.concat(out, r["ids"])).alias("ids"))
