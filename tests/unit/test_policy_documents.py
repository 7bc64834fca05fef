"""Policies and whole-document operators."""

import re

import pytest

from quillfold.operators import documents as D
from quillfold.operators import policy as P


def test_policies(spark):
    make = lambda rows: spark.createDataFrame(rows, "label string, action string")
    assert {(r.label, r.change) for r in P.diff(make([("A", "mask"), ("B", "hash")]), make([("A", "remove"), ("C", "keep")])).collect()} == {("A", "stronger"), ("B", "removed"), ("C", "added")}
    assert P.lint(make([("A", "mask"), ("A", "hash"), ("B", "melt"), ("S", "keep")]), ["S", "T"]) == ["A: several actions", "B: unknown action", "S: required", "T: required"]
    options = spark.createDataFrame([(1, "mask", 0.2), (1, "hash", 0.05), (1, "remove", 0.0), (2, "mask", 0.9)], "id int, action string, residual double")
    assert {r.id: r.action for r in P.weakest_sufficient(options, ["id"], "residual", 0.1).collect()} == {1: "hash", 2: "remove"}


def test_calibration(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.25, 0.5, 0.75, 2.0)], "s double").select(P.calibrated("s", [(0.0, 0.1), (0.5, 0.4), (1.0, 0.9)])).collect()
    assert [round(r[0], 6) for r in rows] == [0.1, 0.1, 0.25, 0.4, 0.65, 0.9]
    pts = P.fit_isotonic(spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "s double, y int"), "s", "y")
    assert [y for _, y in pts] == sorted(y for _, y in pts)
    with pytest.raises(ValueError):
        P.calibrated("s", [])


def test_consent(spark):
    consent = spark.createDataFrame([("a", "r", True), ("b", "r", True), ("b", "r", False), ("c", "x", True)], "subject string, use string, allowed boolean")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "who string")
    assert [r.who for r in P.consented(rows, consent, "who", "r").collect()] == ["a"]


def test_script_type_and_masks(spark):
    df = spark.createDataFrame([("hello",), ("Привет, x",), ("שלום",), ("123",), (None,)], "t string")
    assert [r[0] for r in df.select(D.script("t")).collect()] == ["latin", "cyrillic", "hebrew", None, None]
    t = spark.createDataFrame([("Findings: x Impression: y technique: z",), ("nothing",)], "t string")
    assert [r[0] for r in t.select(D.document_type("t")).collect()] == ["radiology_report", "unknown"]


def test_script_routing_agrees_with_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from quillfold.plans.catalogue import ORACLE, QUERIES

    texts = ["hello", "Привет, x", "שלום", "123", None, "", "éà", "αβγ a", "x\ny", "世界", "Ж"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["script_routing"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["script_routing"](spark, str(tmp_path)).collect()) == want
    assert len(want) == len(texts) - 1


def test_windows_agree_with_greedy_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2000").limit(30)
    got = {}
    for r in D.sentence_windows(docs, 300).orderBy("doc_id", "window").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for r in docs.collect():
        want = []
        for s in (x.strip(" ") for x in re.split("\n+", re.sub(r"([.!?])[ \t]+", r"\1\n", r.text))):
            if s and want and sum(len(x) + 1 for x in want[-1]) + len(s) <= 300:
                want[-1].append(s)
            elif s:
                want.append([s])
        assert got.get(r.doc_id, []) == [" ".join(w) for w in want]
    two = [r.text for r in D.sentence_windows(spark.createDataFrame([(1, "Aa. Bb. Cc. Dd.")], "doc_id int, text string"), 8, overlap=1).orderBy("window").collect()]
    assert two == ["Aa. Bb.", "Bb. Cc. Dd."]


def test_windows_of_whole_and_very_long_texts(spark):
    from quillfold.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.where("n_chars >= 3000").count() > 0
    assert QUERIES["document_windows"](spark, sf).count() == docs.where("text RLIKE '[^ \\\\n]'").select("doc_id").distinct().count()
    text = " ".join(f"Sentence number {i}." for i in range(40_000))
    rows = D.sentence_windows(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), 400).orderBy("window").collect()
    assert {r.doc_id for r in rows} == {1} and [r.window for r in rows] == list(range(len(rows)))
    assert " ".join(r.text for r in rows) == text and max(len(r.text) for r in rows) <= 400
