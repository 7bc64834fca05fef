"""Normal forms and the way back."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillfold.functions import normalize as N

CHARS = ["a", "e", "́", "̧", "̈", "é", "ﬁ", "ᄀ", "ᅡ", "ᆨ", "가", "Å", "①", "ͅ", "α", "\U0001f642", " ", "ཱ", "ི", "क़", "̈́"]


@pytest.mark.parametrize("form", N.FORMS)
def test_forms_and_maps(form):
    rng = random.Random(form)
    for _ in range(3000):
        text = "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 9)))
        new, places = N.mapped(text, form)
        assert new == unicodedata.normalize(form, text)
        if places is not None:
            assert len(places) == len(new) + 1 and places == sorted(places) and places[-1] == len(text)
            for a, b in N.parts(text, form):  # a part's form lies where its source does
                at = [i for i, p in enumerate(places[:-1]) if a <= p < b]
                assert "".join(new[i] for i in at) == unicodedata.normalize(form, text[a:b])


def test_spans_go_back(spark):
    text = "café ﬁne Å end"
    rows = spark.createDataFrame([(text,), ("plain",), (None,), ("",)], "t string").select("t", N.normal_form("t", "NFKC").alias("n"))
    got = rows.where(F.col("t") == text).select("n.text", *(N.source_span(F.col("n.places"), F.lit(a), F.lit(b)).alias(f"s{i}") for i, (a, b) in enumerate([(0, 4), (5, 9), (6, 7), (10, 11), (12, 15)]))).first()
    assert got.text == "café fine Å end"
    assert [text[s.start : s.end] for s in got[1:]] == ["café", "ﬁne", "ﬁ", "Å", "end"]
    plain = rows.where("t = 'plain'").select(N.source_span(F.col("n.places"), F.lit(1), F.lit(3)).alias("s"), "n.places").first()
    assert (plain.s.start, plain.s.end, plain.places) == (1, 3, None)
    assert rows.where("t IS NULL").first().n.text is None and rows.where("t = ''").first().n.text == ""


def test_forms_leave_in_chunks_and_without_maps(spark, monkeypatch):
    monkeypatch.setattr(N, "FLUSH", 100)
    texts = [None if i % 7 == 0 else "xe\u0301" * (i % 50) for i in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    for places in (True, False):
        got = rows.select("i", N.normal_form("t", places=places).alias("n")).select("i", "n.*").orderBy("i").collect()
        assert [r.text for r in got] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
        assert [r.places for r in got] == [N.mapped(t, "NFC")[1] if places and t is not None else None for t in texts]


def test_nfc_texts_makes_no_map(spark, sf, monkeypatch):
    from quillfold.plans.catalogue import QUERIES

    asked = []
    monkeypatch.setattr(N, "normal_form", lambda text, form="NFC", places=True, f=N.normal_form: (asked.append(places), f(text, form, places))[1])
    QUERIES["nfc_texts"](spark, sf)
    assert asked == [False] and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
