"""Scores, releases, national identifiers and the anonymiser's further demands, against values worked out here."""

import pytest
from pyspark.sql import functions as F

from quillfold.functions import validators as V
from quillfold.operators import dp, entities, lattice, metrics, privacy
from quillfold.operators import spans as S


def ok(spark, check, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(check("v")).collect()]


def test_national_identifiers(spark):
    good = {"nhs": "943 476 5919", "pesel": "44051401359", "bsn": "111222333", "dni": "12345678Z", "nir": "255081416802538", "cpf": "529.982.247-25", "sin": "046 454 286", "tfn": "123 456 782", "steuer_id": "86095742719", "hetu": "131052-308T", "pan": "ABCPE1234F", "gstin": "27AAPFU0939F1ZV"}
    for name, value in good.items():
        last = value[-1]
        bad = value[:-1] + ("0" if last != "0" else "1") if last.isdigit() else value[:-1] + ("A" if last != "A" else "B")
        got = ok(spark, getattr(V, name), value, bad if name != "pan" else "ABCXE1234F", "", None)
        assert got[0] is True and got[1] is False and not got[2] and not got[3], (name, got)


def test_registered_detectors_are_found(spark):
    before = {k: dict(t) for k, t in (("p", S.PATTERNS), ("v", S.VALIDATORS), ("s", S.BASE_SCORE), ("c", S.CONTEXT), ("b", S.PROBES))}
    try:
        assert "DNI" in S.national(["ES", "PL"])
        S.register("WARD", r"(^|[^A-Z])(W-[0-9]{3})", lambda c: c != "W-000", 0.9, ("contains", "W-"))
        docs = spark.createDataFrame([("DNI 12345678Z or 12345678A; W-123, W-000; 44051401359",)], "text string")
        got = S.deidentify(docs, ["DNI", "PESEL", "WARD"]).first()
        assert got.redacted == "DNI [DNI] or 12345678A; [WARD], W-000; [PESEL]"
    finally:
        for table, held in zip((S.PATTERNS, S.VALIDATORS, S.BASE_SCORE, S.CONTEXT, S.PROBES), before.values()):
            table.clear()
            table.update(held)


def test_student_p_and_welch(spark):
    assert metrics.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4) and metrics.student_p(12.706, 1) == pytest.approx(0.05, abs=1e-4) and metrics.student_p(0, 5) == pytest.approx(1)
    rows = [("a", x) for x in (27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4)] + [("b", x) for x in (27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 31.3)]
    w = metrics.welch_test(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").first()
    assert w.t == pytest.approx(2.9, abs=0.2) and 25 < w.df < 28.1 and 0.004 < w.p < 0.012
    with pytest.raises(ValueError):
        metrics.welch_test(spark.createDataFrame([("a", 1.0)], "g string, v double"), "v", "g", "a", "b")


def test_noise_is_of_the_stated_scale(spark):
    rows = spark.range(4000).select("id", F.lit(0).alias("n"), F.lit(0.0).alias("total"))
    lap = dp.release(rows, dp.Budget(1.0), 1.0, 0, 10, seed=3).agg(F.avg(F.abs("n")).alias("n"), F.avg(F.abs("total")).alias("t"), F.avg("n").alias("m")).first()
    assert lap.n == pytest.approx(2, rel=0.1) and lap.t == pytest.approx(20, rel=0.1) and abs(lap.m) < 0.2
    sd = dp.gaussian_sd(1, 0.5, 5e-6)
    gauss = dp.release(rows, dp.Budget(1.0, 1e-5), 1.0, 0, 10, seed=3, delta=1e-5).agg(F.stddev("n").alias("n"), F.avg("n").alias("m")).first()
    assert gauss.n == pytest.approx(sd, rel=0.1) and abs(gauss.m) < sd / 10
    with pytest.raises(PermissionError):
        dp.release(rows, dp.Budget(1.0), 1.0, 0, 10, seed=3, delta=1e-5)


def test_anonymize_holds_diversity_and_closeness(spark):
    rows = [(20 + i % 40, f"{i % 9:03d}", "flu" if i % 40 < 20 else f"d{i % 4}", f"p{i}") for i in range(360)]
    df = spark.createDataFrame(rows, "age int, zip string, diagnosis string, name string")
    kinds = {"age": "age", "zip": "zip"}
    out, _ = lattice.anonymize(df, kinds, 3, 200, ["name"], l=2, t=0.6, sensitive="diagnosis")
    assert out.count() > 0 and "name" not in out.columns
    assert privacy.l_report(out, ["age", "zip"], "diagnosis", 2).first().achieved_distinct >= 2
    by_role, plan = lattice.anonymize_by_role(df, 3, kinds, 300, l=2)
    assert sorted(by_role.columns) == ["age", "diagnosis", "zip"] and privacy.k_report(by_role, ["age", "zip"], 3).first().achieved_k >= 3
    with pytest.raises(ValueError):
        lattice.anonymize(df, kinds, 3, l=2)


def test_reports_hold_no_surfaces(spark):
    spans = spark.createDataFrame([(1, 0, 5, "MRN", "Ab-12", "mask"), (1, 9, 12, "MRN", "xyz", "mask"), (None, 0, 1, "Z", None, "hash")], "doc_id long, start int, end int, label string, surface string, action string")
    rows = {(r.doc_id, r.label): (r.n, r.chars) for r in entities.audit(spans).collect()}
    assert rows == {(1, "MRN"): (2, 8), (None, "Z"): (1, 1)}
    assert [r["shape"] for r in entities.preview(spans).collect()] == ["Aa-99", "aaa", None]
    s = spark.range(50)
    assert entities.sample_rows(s, ["id"], 7, 1).collect() == entities.sample_rows(s.repartition(5), ["id"], 7, 1).collect()
