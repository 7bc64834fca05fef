import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillfold.llm import secrets as sx

RULES = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def brute(text):
    found = [(m.start(), m.end(), kind) for kind, (rule, keep) in RULES.items() for m in rule.finditer(text or "") if keep(m)]
    return sorted(found, key=lambda s: (s[0], sx.KINDS.index(s[2])))


def base(text):
    return [s for s in sx.find_secrets(text) if s[2] in sx.BASE]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", "secret", "passwd", "AKIA", "akia", "=", ":", ' "', "' ", " ", "é", "ſ", "K", "😀", "\n", "abcdef0123456789", "A1B2C3D4E5F6G7H8", "0", "f", "x.y/z+", "secretsecret", "ghp_"]), max_size=14).map("".join))
def test_base_spans_agree_with_the_plain_expressions(text):
    assert base(text) == brute(text)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in sx.digest(sx.scan(docs)).collect()}
    total = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        want, r = brute(text), got[doc_id]
        total += len(want)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for *_, k in want) for kind in sx.BASE)
    assert total > 0


def test_checksums():
    body = b"abcdefghijklmnopqrstuvwxyz0123"
    good = f"ghp_{body.decode()}{sx.base62_crc(body).decode()}"
    assert (2, 42, "github") in sx.find_secrets("é " + good)
    assert not any(k == "github" for *_, k in sx.find_secrets(good[:-1] + ("0" if good[-1] != "0" else "1")))
    key = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert [(0, 111, "xprv")] == sx.find_secrets(key)
    assert sx.find_secrets(key[:-1] + "j") == []


def test_edge_rows_and_redaction(spark):
    long = "x " * 50_000 + "token=abcdefghijklmnop"
    rows = [(1, None, 0), (2, "", 0), (3, "é password: 'hunter2hunter2' ok", 31), (3, "é password: 'hunter2hunter2' ok", 31), (4, long, len(long)), (5, "secret=deadbeefdeadbeef00", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = sx.digest(sx.scan(docs.withColumn("spans", docs.text))).collect()
    assert sorted(r.spans for r in out if r.doc_id == 5) == ["assign:0:25,hex:7:25"]
    assert len(out) == 6 and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out if r.doc_id < 3)
    clean = {(r.doc_id, r.text, r.n_chars) for r in sx.redact(docs).collect()}
    assert (3, "é [ASSIGN]' ok", 14) in clean and (5, "[ASSIGN]", 8) in clean and (1, None, 0) in clean
    assert sx.scan(docs.limit(0)).count() == 0 and sx.redact(docs.limit(0)).count() == 0


def test_a_batch_of_long_texts_is_worked_on_in_parts(spark):
    """What a worker holds is bounded by bytes of text, not by rows alone; every row comes out, in order."""
    texts = [None, "", *(f"{i} token=abcdefghijklmnop " + "long words " * 6000 for i in range(120)), "secret=deadbeefdeadbeef00 " + "x " * 2_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    size = lambda b: sum(len(t or "") for t in b.column("text").to_pylist())

    class Rows:
        columns, schema, sparkSession = ["doc_id", "text"], None, spark

        def mapInArrow(self, f, schema):
            return f

    parts = list(sx.redact(Rows())(iter([batch])))
    assert all(size(p) <= 2 << 20 for p in parts if p.num_rows > 1) and len(parts) > 3
    out = pa.Table.from_batches(parts)
    assert out.column("doc_id").to_pylist() == list(range(len(texts)))
    assert out.column("text").to_pylist() == [sx.masked(t, sx.find_secrets(t)) for t in texts]
