import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillfold.llm import token_store as ts
from quillfold.llm.encode import tokenizer_path


def brute(rows):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_checks_agree_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = ts.write_store(docs)
    got = ts.read_checks(spark, folder).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute(docs.select("doc_id", "text").orderBy("doc_id").collect())
    assert all(r.verified for r in got)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r.n_chunks for r in got)
    for r in ts.read_documents(spark, folder).limit(20).join(docs.withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k")).collect():
        want = [*Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(r.text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(bytes(r.ids), "<u2").tolist() == want


def test_edge_rows(spark):
    long = "the lazy dog jumps  over\n\n the fence. " * 4000
    rows = [(3, None, "x"), (1, "", "y"), (2, long, "z"), (2, long, "z"), (5, " é  <|endoftext|> a | b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    got = ts.read_checks(spark, ts.write_store(docs)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute(sorted((r[:2] for r in rows), key=lambda r: r[0]))
    assert ts.read_checks(spark, ts.write_store(docs.limit(0))).count() == 0


def test_a_damaged_chunk_is_found(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "doc_id long, text string")
    folder = ts.write_store(docs)
    chunks = spark.read.parquet(f"{folder}/chunks").collect()
    spark.createDataFrame([(c.digest, c.payload if i else b"\0\0" + bytes(c.payload[2:])) for i, c in enumerate(chunks)], "digest binary, payload binary").write.mode("overwrite").parquet(f"{folder}/chunks")
    assert sorted(r.verified for r in ts.read_checks(spark, folder).collect()) == [False, True]


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50_000, 20_000)
    b = np.concatenate([rng.integers(0, 50_000, 777), a])
    ends_a, ends_b = ts.cut_points([a, b])
    pieces = lambda x, ends: {hashlib.sha256(x[i:j].tobytes()).digest() for i, j in zip([0, *ends], ends)}
    assert len(pieces(a, ends_a) & pieces(b, ends_b)) >= len(ends_a) - 3
    assert all(e[-1] == len(x) and max(np.diff([0, *e])) <= ts.MOST for x, e in ((a, ends_a), (b, ends_b)))


@pytest.mark.parametrize("cut", [(5,), (1, 2, 3), (100, 4000)])
def test_checksum_shares(cut):
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8).tobytes()
    ends = [*cut, len(data)]
    parts = [data[i:j] for i, j in zip([0, *ends], ends)]
    after = np.array([len(data) - e for e in ends])
    assert np.bitwise_xor.reduce(ts.crc_share(np.array([zlib.crc32(p) for p in parts]), after)) == zlib.crc32(data)


def test_ids_beyond_the_width_are_refused(spark):
    docs = spark.createDataFrame([(None, "one two three"), (2, None)], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        ts.write_store(docs, width=1)
    got = ts.read_checks(spark, ts.write_store(docs)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2] and all(r.verified for r in got)
