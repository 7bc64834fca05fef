"""Chroma audio fingerprints of a media column, and their alignment.

Fingerprint: overlapping frames of the recording are folded into 12 pitch classes; an integral image over (frame, pitch
class) gives any rectangle's sum in four reads; 16 fixed rectangle filters compare log sums, each quantised to two Gray
coded bits, and the 16 make one 32-bit integer for each window of frames.

Alignment: recordings with equal fingerprints are one class, named by its least id. Query classes (those that hold an id
divisible by ``QUERY_EVERY``) are dealt into blocks, and every class meets every block. A class's single integers, and
all that differ from one in ``FLIPS`` bits at most (in two where a recording is short), are looked up among the block's
by binary search; matches vote for (query, offset), and an offset needs one vote, more only where the overlap is long.
Where either recording has at most ``SHORT`` integers, every offset is scored instead. Offsets are judged by the bit
errors of all integers that then lie on each other. A link is at most ``MOST_ERRORS`` of the bits over at least
``LEAST_OVERLAP`` of the shorter recording. Only each class's count of links and its best one leave the task, so a large
group of alike recordings makes no rows for its pairs.

Defined cases: a null or too short recording has no fingerprint, and is linked with nothing and its own class; all-zero
audio fingerprints like any constant; rows that share an id are one recording if alike, else the least counts; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import prepare, spool

RATE, FRAME, HOP = 4000, 1024, 512
LOW_HZ, HIGH_HZ = 55.0, 1760.0
WIDTH = 8  # frames of the widest filter
PAIR = 3  # windows between the two integers of a lookup key
VOTES = 3  # needed at most
SHORT, MIDDLE = 32, 64  # integers: every offset is scored up to SHORT, two bits are flipped up to MIDDLE
FLIPS, PER_VOTE = 1, 100  # bits flipped in a probe; integers of overlap to a needed vote
MOST_ERRORS, LEAST_OVERLAP = 0.15, 0.5
QUERY_EVERY, BLOCK = 20, 2048


def filters(count: int = 16) -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, height, width) by a rule: six shapes over walking bands and widths."""
    return [(k % 6, (5 * k) % 9, 3 + (k * 2) % 4 if (5 * k) % 9 + 3 + (k * 2) % 4 <= 12 else 12 - (5 * k) % 9, (2, 4, 8, 6)[k % 4]) for k in range(count)]


def chroma(pcm: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, 12): energy of each pitch class, each frame scaled to length one."""
    if len(pcm) < frame:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm, frame)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(frame).astype(np.float32), axis=1)) ** 2
    out = power @ _folding(rate, frame)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0)


def _folding(rate: int, frame: int) -> np.ndarray:
    hz = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if LOW_HZ <= f <= HIGH_HZ:
            out[i, round(12 * math.log2(f / 440.0)) % 12] = 1
    return out


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers (uint32), one for each window of ``WIDTH`` frames."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[at + t1, p1] - total[at + t0, p1] - total[at + t1, p0] + total[at + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    for k, (shape, p, h, w) in enumerate(filters()):
        half, mid, third = w // 2, p + h // 2, max(1, h // 3)
        whole = area(0, w, p, p + h)
        part = (
            lambda: whole / 2 if w == WIDTH else area(0, WIDTH, p, p + h) - whole,
            lambda: area(0, w, mid, p + h),
            lambda: area(half, w, p, p + h),
            lambda: area(0, half, p, mid) + area(half, w, mid, p + h),
            lambda: area(0, w, p + third, p + 2 * third),
            lambda: area(half // 2, half // 2 + half, p, p + h),
        )[shape]()
        value = np.log1p(10 * np.maximum(whole - part, 0)) - np.log1p(10 * np.maximum(part, 0))
        step = np.digitize(value, (-0.6, 0.0, 0.6)).astype(np.uint32)
        out |= (step ^ (step >> np.uint32(1))) << np.uint32(2 * k)
    return out


def tones(values: list[float] | None, rate: int = RATE, note: int = 1024) -> np.ndarray | None:
    """A recording played from a vector: a note for each component, its pitch and its overtone from the value."""
    if not values:
        return None
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in values], dtype=np.float64), posinf=0, neginf=0)
    semitone = np.clip(np.round(40 * x), -18, 18)
    hz = 440.0 * 2 ** (semitone / 12)
    t = np.arange(note) / rate
    wave = np.sin(2 * np.pi * hz[:, None] * t) + 0.3 * np.sin(2 * np.pi * 1.5 * hz[:, None] * t)
    return (wave * np.minimum(1, np.minimum(t, t[::-1]) * 100)).astype(np.float32).ravel()


def fingerprints(df: DataFrame, id_col: str, media_col: str, decode: Callable = lambda pcm: pcm) -> DataFrame:
    """id, fp (uint32, little-endian), null where there is none. ``decode`` makes samples of a media value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(1).to_pylist():
                pcm = None if value is None else decode(value)
                fp = fingerprint(chroma(np.asarray(pcm, dtype=np.float32))) if pcm is not None else ()
                found.append(fp.astype("<u4").tobytes() if len(fp) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "fp"])

    prepare(df.sparkSession)
    return df.select(F.col(id_col).cast("long"), media_col).mapInArrow(run, "id long, fp binary")


def keys_of(fp: np.ndarray) -> np.ndarray:
    """Lookup keys: two integers, ``PAIR`` windows apart."""
    if len(fp) <= PAIR:
        return np.zeros(0, dtype=np.uint64)
    return (fp[:-PAIR].astype(np.uint64) << np.uint64(32)) | fp[PAIR:]


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(different bits, integers on each other) with b's integer t on a's t + offset."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()), hi - lo


def flips(bits: int) -> np.ndarray:
    """Masks of at most so many bits, zero among them."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(32), n)], dtype=np.uint32)


class Index:
    """The query recordings of a block, by integer."""

    def __init__(self, ids: list[int], fps: list[np.ndarray]):
        self.ids, self.fps = ids, fps
        self.sizes = np.array([len(f) for f in fps], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, dtype=np.uint32), *fps]).astype(np.uint32)
        self.short = np.flatnonzero(self.sizes <= SHORT)
        self.least = int(self.sizes[self.sizes > SHORT].min(initial=1 << 30))
        owner = np.repeat(np.arange(len(fps)), self.sizes)
        time = np.arange(len(self.flat)) - self.starts[owner]
        order = np.argsort(self.flat, kind="stable")
        order = order[self.sizes[owner[order]] > SHORT]
        self.keys, self.owner, self.time = self.flat[order], owner[order], time[order]

    def voted(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, offset) with enough votes, of the queries that are not short."""
        masks, span, bias = flips(2 if min(len(fp), self.least) <= MIDDLE else FLIPS), 1 << 32, 1 << 31
        probes, at_time = (fp[:, None] ^ masks).ravel(), np.repeat(np.arange(len(fp)), len(masks))
        a, b = np.searchsorted(self.keys, probes, "left"), np.searchsorted(self.keys, probes, "right")
        met = np.flatnonzero(b > a)
        a, hits, at_time = a[met], (b - a)[met], at_time[met]
        codes, votes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for part in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(np.cumsum(hits) // 4_000_000)) + 1):  # bounded by key, not by pair
            n = hits[part]
            at = np.repeat(a[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            code, count = np.unique(self.owner[at] * span + (self.time[at] - np.repeat(at_time[part], n)) + bias, return_counts=True)
            codes.append(code)
            votes.append(count)
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        votes = np.bincount(where, weights=np.concatenate(votes), minlength=len(code))
        q, offset = code // span, code % span - bias
        overlap = np.minimum(self.sizes[q], len(fp) + offset) - np.maximum(0, offset)
        enough = votes >= np.clip(overlap // PER_VOTE, 1, VOTES)
        return q[enough], offset[enough]

    def judged(self, q: np.ndarray, offset: np.ndarray, fp: np.ndarray) -> list[tuple]:
        """(query, error rate, query id, offset, bit errors, overlap) of the places that are links."""
        lo, hi = np.maximum(0, offset), np.minimum(self.sizes[q], len(fp) + offset)
        n = hi - lo
        ok = (n > 0) & (n >= LEAST_OVERLAP * np.minimum(len(fp), self.sizes[q]))
        q, offset, lo, n, out = q[ok], offset[ok], lo[ok], n[ok], []
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1):
            if not len(part):
                continue
            m = n[part]
            ends = np.cumsum(m)
            step = np.arange(ends[-1]) - np.repeat(ends - m, m)
            one = self.flat[np.repeat(self.starts[q[part]] + lo[part], m) + step]
            errors = np.add.reduceat(np.bitwise_count(one ^ fp[np.repeat(lo[part] - offset[part], m) + step]), ends - m, dtype=np.int64)
            for k in np.flatnonzero(errors <= MOST_ERRORS * 32 * m):
                i, e, w = part[k], int(errors[k]), int(m[k])
                out.append((int(q[i]), e / (32 * w), self.ids[q[i]], int(offset[i]), e, w))
        return out

    def links(self, own: int, fp: np.ndarray) -> list[tuple[float, int, int, int, int]]:
        """(error rate, query id, offset, bit errors, overlap) of every query recording that this one lies on."""
        whole, places = np.arange(len(self.fps)) if len(fp) <= SHORT else self.short, []
        n = self.sizes[whole] + len(fp) - 1
        for part in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(np.cumsum(n) // 500_000)) + 1):
            step = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            places.append(self.judged(np.repeat(whole[part], n[part]), step + 1 - len(fp), fp))
        if len(fp) > SHORT:
            places.append(self.judged(*self.voted(fp), fp))
        best: dict[int, tuple] = {}
        for q, *row in (x for found in places for x in found):
            if self.ids[q] != own:
                best[q] = min(best.get(q, row), row, key=lambda r: (-r[4], r[0], abs(r[2]), r[2]))
        return [tuple(r) for r in best.values()]


def align(prints: DataFrame, query_every: int = QUERY_EVERY, parts: int | None = None) -> DataFrame:
    """id, class_id, n_ints, n_links, best_query, best_offset, best_errors, best_overlap: a row for each recording.

    ``n_links`` counts the query classes other than its own on which the recording lies; the best is the one with the
    lowest error rate, then the least id. The offset is the recording's start in the query, in hops.
    """
    spark = prints.sparkSession
    prints = spool(prints.withColumn("key", F.sha2("fp", 256)))
    usable = prints.where("fp IS NOT NULL AND id IS NOT NULL")
    asked = F.max((F.pmod("id", F.lit(query_every)) == 0).cast("int"))
    classes = spool(usable.groupBy("key").agg(F.min("id").alias("class_id"), asked.alias("asked"), F.min("fp").alias("fp")))
    queries, n = classes.where("asked = 1"), classes.agg(F.sum("asked").alias("q"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(n["q"] or 0) // BLOCK))
    parts = parts or max(1, -(-n["n"] // 4000))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("class_id"), F.lit(k)).cast("int")
    left = queries.select(dealt(blocks).alias("block"), every(parts).alias("part"), "class_id", "fp")
    right = classes.select(every(blocks).alias("block"), dealt(parts).alias("part"), "class_id", "fp")

    def run(asked, rest):
        views = lambda t: [np.frombuffer(x, "<u4") for x in t.column("fp").to_pylist()]
        index, rows = Index(asked.column("class_id").to_pylist(), views(asked)), []
        for own, fp in zip(rest.column("class_id").to_pylist(), views(rest)):
            if found := index.links(own, fp):
                rows.append((own, len(found), *min(found)))
        names = ("class_id", "n_links", "rate", "best_query", "best_offset", "best_errors", "best_overlap")
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(zip(names, kinds))})

    schema = "class_id long, n_links long, rate double, best_query long, best_offset long, best_errors long, best_overlap long"
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)
    best = met.groupBy("class_id").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("rate", "best_query", "best_offset", "best_errors", "best_overlap")).alias("b"))
    best = classes.select("key", "class_id").join(best, "class_id", "left").select("key", "class_id", "n_links", "b.best_query", "b.best_offset", "b.best_errors", "b.best_overlap")
    rows = prints.select("id", "key", F.coalesce(F.length("fp") / 4, F.lit(0)).cast("long").alias("n_ints"))
    out = rows.join(best, "key", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), "n_ints", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best_query", "best_offset", "best_errors", "best_overlap")
