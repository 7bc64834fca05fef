import zlib

import numpy as np
from tokenizers import Tokenizer

from quillfold.llm import packing as pk
from quillfold.llm.encode import tokenizer_path


def check(rows, packed, capacity=2048):
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((k, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows)
    by_doc, by_seq = {}, {}
    for r in packed.placed.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc_id, ids in want:
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return sum(len(ids) for _, ids in want) / (capacity * len(by_seq))


def test_pieces_and_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = pk.pack(docs.repartition(5))
    assert check(docs.select("doc_id", "text").collect(), packed) > 0.97
    whole = pk.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in packed.placed.collect())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "A  b\tC " * 9000), (4, "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, offset int")
    check(rows, pk.pack(docs))
    assert pk.pack(docs.limit(0)).placed.count() == 0
    twice = pk.pack(docs.union(docs)).placed
    assert twice.count() == 2 * pk.pack(docs).placed.count() and twice.select("sequence_id", "offset").distinct().count() == twice.count()


def test_column_generation_reaches_the_optimum():
    sizes, counts = np.array([3, 4, 5]), np.array([30.0, 20.0, 40.0])  # capacity 8: 5+3 and 4+4 leave nothing
    found = pk.solve(sizes, counts, 8)
    assert abs(sum(x for x, _ in found) - 50) < 1e-6
    assert np.allclose(sum(x * p for x, p in found), counts)


def test_layout_covers_every_rank_once():
    rng = np.random.default_rng(3)
    counts = {int(s): int(rng.integers(1, 400)) for s in rng.choice(np.arange(1, 513), 200, replace=False)}
    rows = pk.lay_out(counts, 2048, 4)
    seen, used = {}, {}
    for cls, lo, hi, a, seq, _ in rows:
        for r in range(lo, hi + 1):
            assert (cls, r) not in seen
            seen[cls, r] = q = seq + (r - lo) // a
            used[q] = used.get(q, 0) + 4 * cls
    assert len(seen) == sum(counts.values()) and max(used.values()) <= 2048
    sizes = np.array(sorted(counts))
    bound = sum(x for x, _ in pk.solve(sizes, np.array([counts[int(s)] for s in sizes], dtype=float), 512))
    assert len(used) <= 1.02 * bound + 5  # the linear program is a lower bound
