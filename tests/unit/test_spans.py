"""Detection, arbitration and redaction against plain re-implementations."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfold.functions import hashing as H
from quillfold.functions import validators as V
from quillfold.operators import spans as S

SPAN = "doc_id int, start int, end int, label string, surface string, score double, detector string"


def test_offsets_are_code_points(spark):
    text = "😀 mail a.b@c.example and é c@d.example, 10.0.0.1 or 999.1.1.1; card 4111111111111111"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    for r in S.detect(docs, ["EMAIL", "IPV4", "CARD"]).collect():
        assert text[r.start : r.end] == r.surface
    valid = {(r.label, r.surface): r.valid for r in S.detect(docs, ["EMAIL", "IPV4", "CARD"]).collect()}
    assert valid[("IPV4", "10.0.0.1")] and not valid[("IPV4", "999.1.1.1")] and valid[("CARD", "4111111111111111")]


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "visa 4111111111111111"), (2, "4111111111111111")], "doc_id int, text string")
    got = {r.doc_id: r.score for r in S.detect(docs, ["CARD"]).collect()}
    assert got[1] == pytest.approx(0.85) and got[2] == pytest.approx(0.75)


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 12), st.integers(1, 5), st.sampled_from(["SSN", "URL", "EMAIL"]), st.sampled_from([0.5, 0.9])), min_size=1, max_size=14))
def test_arbitration(spark, rows):
    rank = {n: r for n, r, _ in S.POLICY}
    spans = [(d, s, s + n, x, "", c, "rules:x") for d, s, n, x, c in rows]
    df = spark.createDataFrame(spans, SPAN).repartition(3)
    kept = {(r.doc_id, r.start, r.end, r.label, r.score) for r in S.resolve_overlaps(df).collect()}
    want = set()
    for d in {r[0] for r in spans}:
        chosen = []
        for x in sorted((r for r in spans if r[0] == d), key=lambda r: (-rank[r[3]], r[1] - r[2], -r[5], r[1], r[2])):
            if all(x[1] >= y[2] or x[2] <= y[1] for y in chosen):
                chosen.append(x)
        want |= {(x[0], x[1], x[2], x[3], x[5]) for x in chosen}
    assert kept == want
    best = [(r.doc_id, r.start, r.end) for r in S.arbitrate_balanced(df).collect()]
    assert len(best) == len(set(best)) and all(not (a[0] == b[0] and a[1] < b[2] and a[2] > b[1]) for a in best for b in best if a != b)


def test_splice_and_actions(spark):
    text = "call 212-555-0100 or mail x@y.example; ssn 123-45-6789"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.redacted for r in S.deidentify(docs, ["PHONE", "EMAIL", "SSN"]).collect()}
    assert got[1] == "call [PHONE] or mail [EMAIL]; ssn " and got[2] == "nothing" and got[3] is None


def test_deidentified_documents_agree_with_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = ["EMAIL", "IPV4", "CARD", "URL"]
    rank = {n: (r, a) for n, r, a in S.POLICY}

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    for row in S.deidentify(docs, labels).collect():
        spans = []
        for x in labels:
            for m in re.finditer(S.PATTERNS[x], row.text, re.ASCII):
                good = (x != "CARD" or luhn(m[2])) and (x != "IPV4" or all(int(p) < 256 for p in m[2].split(".")))
                if good:
                    spans.append((m.start(2), m.end(2), x, m[2]))
        spans.sort()
        clusters, reach = [], -1
        for s in spans:
            if s[0] >= reach:
                clusters.append([])
            clusters[-1].append(s)
            reach = max(reach, s[1])
        out, at = [], 0
        for c in clusters:
            a, b, x, surface = max(c, key=lambda s: (rank[s[2]][0], s[1] - s[0], -s[0]))
            act = rank[x][1]
            new = {"remove": "", "hash": f"{x}_{hashlib.sha256(surface.encode()).hexdigest()[:8]}", "keep": surface, "shift": surface}.get(act, f"[{x}]")
            out += [row.text[at:a], new]
            at = b
        assert row.redacted == "".join([*out, row.text[at:]]) and row.n_spans == len(clusters)


def test_masks_are_numbered_and_undone(spark):
    spans = spark.createDataFrame([(1, 0, 3, "N", "Ann", 1.0, "d"), (1, 8, 11, "N", "Bob", 1.0, "d"), (1, 16, 19, "N", "Ann", 1.0, "d")], SPAN)
    rows = S.numbered_masks(spans).orderBy("start").collect()
    assert [r["mask"] for r in rows] == ["[N]", "[N_2]", "[N]"]
    docs = spark.createDataFrame([(1, "[N] and [N_2] and [N]")], "doc_id int, redacted string")
    mapping = spark.createDataFrame([(1, "[N]", "Ann"), (1, "[N_2]", "Bob")], "doc_id int, placeholder string, surface string")
    assert S.reidentify(docs, mapping).first().restored == "Ann and Bob and Ann"


def test_allow_list_sweep_and_merge(spark):
    spans = spark.createDataFrame([(1, 0, 4, "URL", "a", 0.5, "d"), (1, 4, 8, "URL", "b", 0.5, "d")], SPAN)
    allowed = spark.createDataFrame([(1, 3, 4)], "doc_id int, start int, end int")
    assert [r.start for r in S.suppress_allowed(spans, allowed).collect()] == [4]
    merged = S.smart_merge(spark.createDataFrame([(1, 0, 2, "A", "", 0.4, "d"), (1, 3, 5, "B", "", 0.9, "d"), (1, 5, 6, "A", "", 0.4, "d"), (1, 20, 22, "B", "", 0.1, "d")], SPAN)).orderBy("start").collect()
    assert [(m.start, m.end, m.label, m.fragments) for m in merged] == [(0, 6, "A", 3), (20, 22, "B", 1)]


def test_keyed_digests(spark):
    import hmac

    key, long = b"k" * 100, "é" * 70
    r = spark.createDataFrame([(long,)], "t string").select(H.hmac_sha256(key, "t").alias("h"), H.hex_mod(F.sha2(F.col("t").cast("binary"), 256), 1009).alias("m"), H.surrogate_key("t", F.lit(1)).alias("s"), H.date_shift_days(b"x", "t", 30).alias("d")).first()
    assert r.h == hmac.new(key, long.encode(), "sha256").hexdigest()
    assert r.m == int(hashlib.sha256(long.encode()).hexdigest(), 16) % 1009
    assert r.s == int.from_bytes(hashlib.sha256(f"{long}\x1f1".encode()).digest()[:8], "big") & (2**63 - 1)
    bucket = int(hmac.new(b"x", long.encode(), "sha256").hexdigest(), 16) % 60
    assert r.d == (bucket - 30 if bucket < 30 else bucket - 29) and r.d != 0


def test_validators(spark):
    def ok(f, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f("v")).collect()]

    assert ok(V.ssn, "123-45-6789", "900-12-3456", "123-45-0000", None) == [True, False, False, None]
    assert ok(V.us_phone, "(212) 555-2100", "1-212-555-2100", "112-555-2100") == [True, True, False]
    assert ok(V.npi, "1234567893", "1234567894", "") == [True, False, False]
    assert ok(V.verhoeff, "236", "237") == [True, False]
    assert ok(V.iban, "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 31") == [True, False]
