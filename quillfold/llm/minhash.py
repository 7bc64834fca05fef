"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard verification.

1. One pass gives each document the digest of its shingle set and its signature. Two permutations make all coordinates:
   the first scatters shingles over ``UNIVERSE`` cells, the second ranks the cells, and coordinate k reads the second
   shifted by k. So the signature of a set is the minimum over rows of one sliding window, read contiguously.
2. Equal sets become one class, named by its least doc_id; only class representatives go on.
3. Bands of the signature are bucket keys. In each bucket members are paired with the least member, never with each
   other. Signatures estimate the pairs: a member surely near (distance at most 0.2 less a margin) needs no more pairs
   in that bucket, because by the triangle inequality whatever is linked to it is itself loosely near the least member.
   Members not surely near go through further rounds with another least member; what is left after ``rounds`` rounds
   stays together without an estimate. Pairs that are at least loosely near form clusters.
4. Clusters are cut into blocks by a hash of the id, and each pair of blocks of a cluster meets in one task with the
   texts of its documents. All pairs between two blocks are verified there on full shingle sets, and the task gives the
   verified links that span its groups. A cluster of any size is thus spread over many tasks, and no pair is a row.
5. Components of the verified links are the result.

With bands of 6 rows and 40 bands, a pair at similarity 0.8 shares no bucket with probability 6e-6.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer words than a
shingle is one shingle; rows that share a doc_id are one document with all their sets, so what links to any of them links
to it, and each row gives its own n_shingles; a row without doc_id is linked with nothing and has no component; very long
texts are handled whole, a document at a time; an empty table gives an empty result; other columns, whatever their names,
are ignored. Ids may be of any type that can be ordered. Of a group the least id stays; of rows with one id and one set,
that with the least text digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .work import discard, prepare, quoted, spool, spread_join, unused

UNIVERSE = 1 << 20
ROWS, BANDS = 6, 40
#: Documents and shingles in a block, about; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Standard deviations of the signature estimate allowed for before a pair counts as surely near or surely far.
MARGIN = 4.5
#: Ids are sent to every task up to so many (8 bytes each); beyond, texts are fetched by a shuffled join.
BROADCAST_ROWS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit keys of the word shingles of a text; A-Z are lowered, words split at ASCII white space."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(h))):
            out = (out ^ h[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(2)
def _windows(width: int) -> np.ndarray:
    """Row s holds the second permutation at s, s + 1, ... around the circle: the ranks under all shifts of a shingle."""
    ranks = np.random.default_rng(20240229).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: width - 1]]), width)


def scatter(keys: np.ndarray) -> np.ndarray:
    """The first permutation: a shingle's cell."""
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - UNIVERSE.bit_length() + 1)).astype(np.int64)


def signature(keys: np.ndarray, width: int = ROWS * BANDS) -> np.ndarray:
    """All coordinates of the signature of a non-empty set."""
    windows, cells = _windows(width), scatter(keys)
    out = windows[cells[:512]].min(axis=0)
    for k in range(512, len(cells), 512):
        np.minimum(out, windows[cells[k : k + 512]].min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, text_key (digest of the text), n_shingles, key (digest of the set), bands (bucket keys), sketch (a byte of
    each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                sizes, keys, bands, sketches = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, words)
                    sizes.append(len(s))
                    if not len(s):
                        for x in (keys, bands, sketches):
                            x.append(None)
                        continue
                    sig = signature(s)
                    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
                    h = salt.copy()
                    with np.errstate(over="ignore"):
                        for k in range(ROWS):
                            h = (h ^ rows[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
                            h ^= h >> np.uint64(31)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(h.view(np.int64))
                    sketches.append(sig.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "text_key", "n_shingles", "key", "bands", "sketch"])

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), text_key(quoted(text_col)).alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs, id_col)}, text_key long, n_shingles long, key binary, bands array<long>, sketch binary")


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (u, v) with sim: the share of equal signature bytes, less what equals by chance."""

    @F.pandas_udf("double")
    def agree(a, b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(map(bytes, s)), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    left, right = (sketches.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "uv")
    return pairs.join(left, "u").join(right, "v").select("u", "v", agree("su", "sv").alias("sim"))


def candidate_edges(reps: DataFrame, similarity: float, rounds: int = 2) -> DataFrame:
    """Links (u, v) such that documents which share a bucket and are similar enough are in one component of them."""
    n = ROWS * BANDS
    sure = similarity + MARGIN * (similarity * (1 - similarity) / n) ** 0.5
    far = 1 - 2 * (1 - similarity)
    loose = far - MARGIN * (far * (1 - far) / n) ** 0.5
    # A document of several sets is any of them here; its links are verified set by set.
    sketches = reps.groupBy("doc_id").agg(F.min("sketch").alias("sketch"))
    # Sets of one document may share a bucket: such rows repeat, which neither a least member nor distinct pairs mind.
    members = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("m"))
    kept = []
    for turn in range(rounds + 1):
        heads = spool(members.groupBy("bucket").agg(F.min("m").alias("p"), F.count("*").alias("n")).where("n > 1"))
        total = heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        starred = spread_join(members, heads, "bucket", "n", total, small=0).where("m <> p")  # heads grow with the input
        if turn == rounds:
            kept.append(starred.select(F.col("p").alias("u"), F.col("m").alias("v")).distinct())
            break
        starred = spool(starred.select("bucket", "p", "m"))
        pairs = starred.select(F.col("p").alias("u"), F.col("m").alias("v")).distinct()
        pairs = spool(_estimated(pairs, sketches))
        kept.append(pairs.where(F.col("sim") >= loose).select("u", "v"))
        open_pairs = pairs.where(F.col("sim") < sure).select(F.col("u").alias("p"), F.col("v").alias("m"))
        members = starred.join(open_pairs, ["p", "m"]).select("bucket", "m")
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out


def block_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that span the groups of similar sets among those given; all pairs are compared."""
    percent, n = round(similarity * 100), len(sets)
    sizes = np.array([len(s) for s in sets])
    keys, where = np.unique(np.concatenate(sets), return_inverse=True)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    shared = np.zeros((n, n), dtype=np.float32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    step = max(1, (16 << 20) // (4 * n))  # cells of the incidence matrix at once
    for lo in range(0, len(keys), step):
        a, b = np.searchsorted(where, (lo, lo + step))
        part = np.zeros((n, min(step, len(keys) - lo)), dtype=np.float32)
        part[owner[a:b], where[a:b] - lo] = 1
        part = part[:, part.sum(axis=0) > 1]
        shared += part @ part.T
    assert ends[-1] == len(owner)
    inter = shared.astype(np.int64)
    close = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    out = []
    for i, j in zip(*np.nonzero(np.triu(close, 1))):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def verified_links(clusters: DataFrame, weights: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """u, v: spanning links of similar documents within clusters (node, root). ``weights`` has doc_id and n_shingles."""
    sizes = clusters.join(weights, clusters["node"] == weights["doc_id"]).groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    placed = clusters.join(sizes, "root").withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # Block b meets every block at or after it; a document goes to each meeting of its block.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    ids = spool(placed.select(F.col("node").alias("id"), "root", "b", "blocks"))
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).where("id IS NOT NULL")
    rows = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id")
    rows = rows.select("id", "text", "root", "b", other)
    rows = rows.select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "id", "text")

    def run(key, table):
        names = table.column("id").to_pylist()
        found = block_links([shingles(t, words) for t in table.column("text").to_pylist()], similarity)
        kind = table.column("id").type
        return pa.table({"u": pa.array([names[i] for i, _ in found], kind), "v": pa.array([names[j] for _, j in found], kind)})

    kind = id_type(docs, id_col)
    return rows.groupBy("root", "i", "j").applyInArrow(run, f"u {kind}, v {kind}")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (node, root) of the linked documents."""
    prepare(docs.sparkSession)
    signed = spool(signatures(docs, id_col, text_col, words))
    usable = signed.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = spool(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep"))
    # Only rows of this very set are copies; a document's other sets go on.
    copies = spool(usable.select("doc_id", "key").join(classes, "key").where("doc_id <> rep").select("doc_id", "rep", "key").distinct())
    # Read several times: by a broadcast each time, or written once, so that bands and sketches are shuffled once at most.
    few, lost = copies.count() <= BROADCAST_ROWS, copies.select("doc_id", "key")
    reps = usable.join(F.broadcast(lost) if few else lost, ["doc_id", "key"], "left_anti").select("doc_id", "bands", "sketch")
    reps = reps if few else spool(reps)
    clusters = components(candidate_edges(reps, similarity))
    links = verified_links(clusters, usable.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), docs, id_col, text_col, words, similarity)
    return signed, components(links.unionByName(copies.select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of its component), kept: a row for each row of the input."""
    signed, found = _grouped(docs, id_col, text_col, words, similarity)
    out = signed.select("doc_id", "n_shingles").join(found, signed["doc_id"] == found["node"], "left")
    component = F.coalesce(F.col("root"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows, all columns, of one document of each group: that with the least id.

    Rows of other documents go. Of the rows that stay and share an id and a set, one stays: that with the least text
    digest, and of equal texts that whose columns have the least digest. Other texts of the id all stay.
    """
    signed, found = _grouped(docs, id_col, text_col, words, similarity)
    (lost,) = unused(docs, "_gone")
    gone = spool(found.where("node <> root").select(F.col("node").alias(lost)))
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, quoted(id_col) == F.col(lost), "left_anti")
    rows = signed.where("doc_id IS NOT NULL")
    again = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min("text_key").alias("least")).where("n > 1")
    again = spool(again.join(gone, F.col("doc_id") == F.col(lost), "left_anti"))
    if again.isEmpty():
        return out
    # Rows of a repeated set: which texts bear it, and which of them stays.
    doc, txt, best, rank = unused(docs, "_doc", "_text", "_best", "_rank")
    same = again["doc_id"].eqNullSafe(rows["doc_id"]) & again["key"].eqNullSafe(rows["key"])
    bound = rows.join(again, same).select(rows["doc_id"].alias(doc), rows["text_key"].alias(txt), (rows["text_key"] == again["least"]).alias(best)).distinct()
    marked = out.join(spool(bound), (quoted(id_col) == F.col(doc)) & (text_key(quoted(text_col)) == F.col(txt)), "left").where(F.coalesce(F.col(best), F.lit(True)))
    once = marked.where(F.col(best).isNotNull())
    order = Window.partitionBy(doc, txt).orderBy(F.xxhash64(*(quoted(c).cast("string") if "map" in t else quoted(c) for c, t in docs.dtypes)))
    once = once.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    every = [quoted(c) for c in docs.columns]
    return marked.where(F.col(best).isNull()).select(*every).unionByName(once.select(*every))
