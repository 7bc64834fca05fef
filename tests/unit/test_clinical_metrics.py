"""Clinical phrases and structures, grounding, metrics."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillfold.functions import clinical as K
from quillfold.operators import clinical as O
from quillfold.operators import grounding as G
from quillfold.operators import metrics as M


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("r")).first().r


@pytest.mark.parametrize(("text", "kind", "value", "unit"), [("SpO2 96% on RA", "oxygen_saturation", 96, "%"), ("Temp 37.5 C", "body_temperature", 37.5, "c"), ("RR: 18/min", "respiratory_rate", 18, "/min"), ("pulse 70", "heart_rate", 70, ""), ("72 bpm", "heart_rate", 72, "bpm"), ("well", "unknown", None, ""), ("", "unknown", None, "")])
def test_vitals(spark, text, kind, value, unit):
    r = one(spark, text, K.vital_sign)
    assert (r.kind, r.value, r.unit) == (kind, value, unit)


def test_blood_pressure_comes_first(spark):
    r = one(spark, "BP 120/80 mmHg, HR 72", K.vital_sign)
    assert (r.kind, r.systolic, r.diastolic, r.unit) == ("blood_pressure", 120, 80, "mmhg")


def test_sigs(spark):
    r = one(spark, "1 tab PO BID x7 days", K.sig)
    assert (r.dose, r.form, r.route, r.frequency_per_day, r.duration_days, r.missing) == (1, "tablet", "oral", 2, 7, [])
    r = one(spark, "1 tab PO q6h PRN pain", K.sig)
    assert (r.frequency_per_day, r.as_needed) == (4, True)
    assert one(spark, "as directed", K.sig).missing == ["dose", "route", "frequency"]


def test_ranges(spark):
    r = one(spark, "70 - 99 mg/dL", K.reference_range)
    assert (r.low, r.high, r.unit) == (70, 99, "mg/dL")
    assert one(spark, ">= 10", K.reference_range).low == 10 and one(spark, "9-3", K.reference_range).low is None


def test_text_helpers(spark):
    assert one(spark, "٣ and ३ and ３", K.fold_digits) == "3 and 3 and 3"
    assert one(spark, "One. Two! Three?\nFour", K.sentences) == ["One.", "Two!", "Three?", "Four"]
    assert str(one(spark, "17.5.2020", K.parse_date)) == "2020-05-17" and one(spark, "soon", K.parse_date) is None
    other = one(spark, "(212) 555-2100", lambda v: K.keep_phone_format(v, "s"))
    assert len(other) == 14 and other[0] == "(" and all(a != b for a, b in zip("2125552100", [c for c in other if c.isdigit()]))
    assert one(spark, "HPI: chest pain", K.section_label) == "history_of_present_illness" and one(spark, "the plan was good", K.section_label) is None


def test_sections_and_spans(spark):
    note = "CC: cough\nHPI: 3 days\nmore\nMedications:\naspirin"
    docs = spark.createDataFrame([(1, note)], "doc_id int, text string")
    found = O.sections(docs)
    rows = [(r.label, note[r.start : r.end]) for r in found.orderBy("start").collect()]
    assert rows == [("chief_complaint", "CC: cough\n"), ("history_of_present_illness", "HPI: 3 days\nmore\n"), ("medications", "Medications:\naspirin")]
    spans = spark.createDataFrame([(1, note.index("aspirin"), 1), (1, 4, 2)], "doc_id int, start int, span_id long")
    assert {r.span_id: r.section for r in O.spans_in_sections(spans, found).collect()} == {1: "medications", 2: "chief_complaint"}


def test_trends(spark):
    rows = [("A", i, float(v), "mm") for i, v in enumerate([1, 2, 3])] + [("b ", 0, 5.0, "mm"), ("B", 1, 4.0, "mm"), ("B", 2, 6.0, "mm"), ("B", 3, 9.0, "cm"), ("c", 0, 1.0, "x"), ("c", 0, 2.0, "x"), ("c", 1, 3.0, "x"), ("d", 0, 1.0, "x"), ("d", 1, 1.0 + 1e-12, "x"), ("e", 0, 1.0, "x")]
    got = {r.entity: r.direction for r in O.trend(spark.createDataFrame(rows, "e string, t int, v double, u string"), "e", "t", "v", "u").collect()}
    assert got == {"a": "up", "b": "mixed", "c": "unknown", "d": "flat", "e": "unknown"}


def test_flowsheet_text(spark):
    t = spark.createDataFrame([(1, "param | 08:00 | 09:00\nHR | 70 | 75\nSpO2 | | 97\n")], "id int, text string")
    got = sorted((r.parameter, r.time, r.value) for r in O.parse_flowsheet(t, "id", "text").collect())
    assert got == [("HR", "08:00", "70"), ("HR", "09:00", "75"), ("SpO2", "09:00", "97")]


def test_problems(spark):
    rows = [("s", "Diabetes", "x", "1", None, "unconfirmed", 5), ("s", "DM2", "x", "1", None, "active", 9), ("s", " diabetes", None, None, None, "refuted", 1), ("s", "other", None, None, "r1", "inactive", 3)]
    got = {r.problem: (r.status, r.mentions) for r in O.problem_list(spark.createDataFrame(rows, "subject string, text string, system string, code string, coref string, status string, offset int")).collect()}
    assert got == {"c:x|1": ("active", 2), "t:diabetes": ("refuted", 1), "r:r1": ("inactive", 1)}


def test_grounding(spark):
    m = spark.createDataFrame([(1, "Heart Attack"), (2, "heart-attack"), (3, "MI"), (4, "zzz")], "mention_id int, surface string")
    a = spark.createDataFrame([("Heart Attack", "C1"), ("myocardial infarction", "C2")], "alias string, code string")
    ab = spark.createDataFrame([("mi", "myocardial infarction")], "short string, alias string")
    assert {r.mention_id: (r.code, r.score) for r in G.lexical_match(m, a, ab).collect()} == {1: ("C1", 1.0), 2: ("C1", 0.95), 3: ("C2", 0.9)}
    best = G.sparse_match(spark.createDataFrame([(1, "hart atack")], "mention_id int, surface string"), a, 1).first()
    assert best["alias"] == "Heart Attack"


def test_scores(spark):
    cols = "doc_id int, start int, end int, label string"
    gold = spark.createDataFrame([(1, 0, 4, "A"), (1, 5, 9, "B")], cols)
    pred = spark.createDataFrame([(1, 0, 4, "A"), (1, 5, 8, "B"), (2, 0, 1, "A")], cols)
    r = M.exact_span_scores(gold, pred).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1) and r.f1 == pytest.approx(0.4)
    leak = {x.label: (x.chars, x.leaked) for x in M.char_leakage(gold, pred).collect()}
    assert leak == {"A": (4, 0), "B": (4, 1)}
    k = M.cohen_kappa(spark.createDataFrame([("y", "y"), ("n", "n"), ("y", "n"), (None, "y")], "a string, b string"), "a", "b").first()
    assert k.n == 3 and k.kappa == pytest.approx(0.4)
    p = M.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "k", "p").collect()
    assert {x.k: round(x.adjusted, 6) for x in p} == {"a": 0.03, "b": 0.04, "c": 0.04}
    assert M.rank_auc(spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True)], "s double, m boolean"), "s", "m").first().auc == pytest.approx(0.75)
    slow = M.stragglers(spark.createDataFrame([(1, 10.0, 10), (2, 11.0, 10), (3, 50.0, 10)], "id int, s double, d int"), "s", "d").collect()
    assert [x.id for x in slow] == [3]


def test_chain(spark):
    rows, prev = [], None
    for i in range(4):
        own = hashlib.sha256(f"{prev or ''}|p{i}".encode()).hexdigest()
        rows.append(("c", i, prev, own, f"p{i}"))
        prev = own
    df = spark.createDataFrame(rows, "c string, i int, prev string, own string, p string")
    assert M.verify_chain(df, "c", "i", "prev", "own", "p").first().broken == 0
    assert M.verify_chain(df.withColumn("p", F.when(F.col("i") == 2, "x").otherwise(F.col("p"))), "c", "i", "prev", "own", "p").first().broken == 1


def test_phrases_are_parsed_once_or_row_by_row(spark, monkeypatch):
    texts = ["5 mg PO BID x3 days", None, "", "2 puffs inhaled daily", "q0h prn", "1 tab po iv q 6 h for 2 weeks"]
    rows = spark.createDataFrame([(i, texts[i % 6]) for i in range(60)], "id long, t string")
    want = {r.id: r.s for r in rows.select("id", K.sig("t").alias("s")).collect()}
    assert want[0].dose == 5 and want[0].frequency_per_day == 2 and want[0].duration_days == 3 and want[1].as_needed is None
    for most in (6, 5):
        monkeypatch.setattr(O, "SMALL_SIDE", most)
        out = O.parsed(rows, "t", K.sig, "s")
        assert out.columns == ["id", "t", "s"] and {r.id: r.s for r in out.collect()} == want
        assert ("regexp_extract" in out._jdf.queryExecution().optimizedPlan().toString()) == (most == 5)


def test_sig_tries_each_expression_once(spark):
    plan = spark.range(3).select(K.sig(F.col("id").cast("string")).alias("s")).select("s.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 6 and "RLIKE" not in plan
