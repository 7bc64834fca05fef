"""Sources, exports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillfold.sources import annotations as A
from quillfold.sources import exports as X
from quillfold.sources import html as H
from quillfold.sources import interchange as I
from quillfold.sources import tables as T
from quillfold.sources import traces as R
from quillfold.streaming import events as E

LABELS = ["EMAIL", "URL"]


@pytest.mark.parametrize("suffix", ["csv", "tsv", "jsonl", "parquet", "orc"])
def test_tables_round_trip(spark, tmp_path, suffix):
    rows = [("a,b\t", 'say "x"\nline'), ("é", "z")]
    df = spark.createDataFrame(rows, "p string, q string")
    path = str(tmp_path / f"t.{suffix}")
    T.write_table(df, path)
    assert sorted(map(tuple, T.read_table(spark, path).select("p", "q").collect())) == sorted(rows)
    with pytest.raises(Exception, match="(?i)already exists"):
        T.write_table(df, path)
    T.write_table(df.limit(1), path, overwrite=True)
    with pytest.raises(ValueError):
        T.read_table(spark, "x.docx")


def test_lake_resumes(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.createDataFrame([("a", "x@y.example"), ("b", "none")], "day string, text string").write.partitionBy("day").parquet(src)
    assert sorted(map(tuple, T.redact_lake(spark, src, dst, "day", ["text"], LABELS).collect())) == [("a", 1), ("b", 1)]
    assert T.redact_lake(spark, src, dst, "day", ["text"], LABELS).count() == 0
    assert sorted(r.text for r in spark.read.parquet(dst).collect()) == ["[EMAIL]", "none"]


def test_quarantine(spark):
    good, bad = T.quarantine(spark.createDataFrame([("fine",), (None,), (" ",), ("a\x00b",), ("b�",), ("long" * 9,)], "text string"), most_chars=20)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["control_characters", "empty", "missing", "oversized", "undecodable"]


def test_html_offsets(spark):
    page = "<html><head><title>t</title></head><body><p>One &amp; <b>two</b></p><script>x('<p>')</script>\n<p>three</p></body></html>"
    assert [page[s:e] == t for t, s, e in H.text_runs(page)] == [True] * len(H.text_runs(page)) and "x(" not in "".join(t for t, _, _ in H.text_runs(page))
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    assert df.select(H.visible_text("html").alias("v")).first().v == "t One & two three"
    assert H.extract(df).where("id = 1 AND text = 'three'").count() == 1


def test_hl7(spark):
    msg = "MSH|^~\\&|A|B\rPID|1||12345^^^H||DOE^JOHN||19700102|M\rOBX|1|TX|n||call a@b.example||\rNTE|1||ok"
    df = spark.createDataFrame([(1, msg)], "id int, message string")
    assert {(r.segment, r.field): r.value for r in I.hl7_fields(df).collect()}[("MSH", 3)] == "A"
    out = I.redact_hl7(df, b"k").first().message.split("\r")
    pid = out[1].split("|")
    assert out[0] == msg.split("\r")[0] and pid[5] == "" and pid[3] != "12345^^^H" and len(pid[7]) == 8 and pid[7] != "19700102" and pid[8] == "M"
    assert out[2] == "OBX|1|TX|n||call [EMAIL]||" and sorted(r.text for r in I.hl7_narrative(df).collect()) == ["call a@b.example", "ok"]


def test_x12(spark):
    claim = "ISA*00~HL*1**20*1~NM1*IL*1*DOE*JOHN****MI*123~N3*1 MAIN~CLM*A*100~"
    df = spark.createDataFrame([(1, claim)], "id int, claim string")
    assert I.redact_x12(df).first().claim == "ISA*00~HL*1**20*1~NM1*IL*1*X*X****MI*X~N3*X~CLM*A*100~"
    assert {r.hl for r in I.x12_elements(df).where("segment = 'CLM'").collect()} == {"1"}


def test_xml_and_resources(spark):
    xml = '<ClinicalDocument xmlns="urn:hl7-org:v3"><given>Ann</given><birthTime value="19700102"/><telecom use="H" value="tel:1"/><section><title>Plan</title><text>mail a@b.example</text></section></ClinicalDocument>'
    df = spark.createDataFrame([(1, xml), (2, "<!DOCTYPE x><a/>")], "id int, xml string")
    out = {r.id: r.xml for r in I.redact_cda(df).collect()}
    assert "Ann" not in out[1] and 'value="1970"' in out[1] and "tel:1" not in out[1] and "[EMAIL]" in out[1] and out[2] is None
    assert [(r.title, r.text) for r in I.cda_sections(df.where("id = 1")).collect()] == [("Plan", "mail a@b.example")]
    lines = [{"resourceType": "Patient", "id": "1", "name": [{"given": ["Ann"]}], "birthDate": "1970-01-02"}, {"resourceType": "Observation", "id": "o", "subject": {"reference": "Patient/1"}}, {"resourceType": "Observation", "id": "q", "subject": {"reference": "Patient/9"}}]
    res = I.fhir_resources(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("junk",)], "value string"))
    assert [(r.source, r.reference) for r in I.dangling_references(res).collect()] == [("Observation/q", "Patient/9")]
    patient = json.loads(I.redact_fhir(res).where("type = 'Patient'").first().resource)
    assert patient["name"] == [] and patient["birthDate"] == "1970"


def test_annotations(spark):
    ann = "T1\tDrug 0 7\taspirin\nT2\tDose 8 12;13 15\t81 m g\nR1\tx"
    got = sorted(tuple(r) for r in A.read_standoff(spark.createDataFrame([(1, ann)], "doc_id int, ann string")).collect())
    assert got == [(1, "T1", "Drug", 0, 7, "aspirin"), (1, "T2", "Dose", 8, 12, "81 m g"), (1, "T2", "Dose", 13, 15, "81 m g")]
    spans = spark.createDataFrame([(1, 0, 7, "Drug", "aspirin")], "doc_id int, start int, end int, label string, surface string")
    assert A.write_standoff(spans).first().ann == "T1\tDrug 0 7\taspirin"
    conll = "take O\naspirin B-Drug\nnow O\n\nalso O\nNSAID B-Drug\ngroup I-Drug\n"
    tokens = A.read_conll(spark.createDataFrame([(1, conll)], "doc_id int, conll string"))
    runs = sorted((r.label, r.start, r.end) for r in A.decode_bio(tokens).collect())
    assert runs == [("Drug", 5, 12), ("Drug", 22, 33)]
    assert A.write_conll(tokens).first().conll == conll
    back = A.encode_bio(tokens.drop("tag"), A.decode_bio(tokens))
    assert [r.tag for r in back.orderBy("pos").collect()] == [r.tag for r in tokens.orderBy("pos").collect()]


def test_traces(spark):
    rec = {"messages": [{"role": "user", "content": "mail a@b.example", "n": 3}, {"role": "assistant", "tool_calls": [{"arguments": '{"to": "a@b.example"}'}]}], "id": "a@b.example"}
    out = R.redact_traces(spark.createDataFrame([(json.dumps(rec),), ("broken",)], "value string"), LABELS).collect()
    new = json.loads(out[0].value)
    assert new["messages"][0]["content"] == "mail [EMAIL]" and json.loads(new["messages"][1]["tool_calls"][0]["arguments"]) == {"to": "[EMAIL]"} and new["id"] == "a@b.example"
    assert R.same_shape(json.dumps(rec), out[0].value) and (out[1].value, out[1].valid) == (None, False)
    nested = spark.createDataFrame([([("user", "x https://a.example/b y")],)], "m array<struct<role string, content string>>")
    assert R.redact_messages(nested, "m", LABELS).first().m[0].content == "x [URL] y"
    log = spark.createDataFrame([('{"level":"info","msg":"to a@b.example \\"now\\""}',), ('{"level":"x"}',)], "value string")
    rows = [json.loads(r.value) for r in R.redact_log_fields(log, ["msg"], LABELS).collect()]
    assert rows == [{"level": "info", "msg": 'to [EMAIL] "now"'}, {"level": "x"}]


def test_exports(spark):
    notes = spark.createDataFrame([("d1", "p1", "t", "2020-01-01")], "document_id string, patient_id string, text string, note_date string")
    ents = spark.createDataFrame([("d1", 0, 3, "flu", "c1", "V", None), ("d1", 4, 6, "dm", "zz", "V", "negated")], "document_id string, start int, end int, text string, code string, vocabulary_id string, negation string")
    concepts = spark.createDataFrame([(11, "V", "c1", 22)], "concept_id long, vocabulary_id string, concept_code string, standard_id long")
    out = X.omop_notes(notes, ents, concepts)
    assert out["condition_occurrence"].first().condition_concept_id == 22 and out["condition_occurrence"].count() == 1
    assert (X.mapping_summary(out["note_nlp"]).first().mapped, X.smoke_check(out, {"person": ["person_id"], "note": ["note_id"]})) == (1, [])
    assert X.smoke_check({}, {"person": []}) == ["person is missing"]
    assert X.flat_table(ents.withColumnRenamed("code", "concept_code")).columns == list(X.FLAT_COLUMNS)
    cond = spark.createDataFrame([("1", "p", "V", "c1", "Flu", "flu", None, 0)], "id string, patient_id string, system string, code string, display string, normalized_text string, negation string, start int")
    bundle = json.loads(X.bundles(X.conditions_json(cond)).first().bundle)
    assert bundle["entry"][0]["resource"]["code"]["coding"][0]["code"] == "c1"
    assert json.loads(X.composition_json(cond, "patient_id").first().composition) == {"encounter/problem_diagnosis:0|value": "flu", "encounter/problem_diagnosis:0|code": "c1"}
    docs = spark.createDataFrame([(1, "flu season is here a@b.example")], "doc_id int, text string")
    hit = X.retrieve(X.retrieval_chunks(docs, LABELS, 2), spark.createDataFrame([(9, "when is flu season")], "question_id int, question string")).first()
    assert (hit.doc_id, hit.chunk, hit.overlap) == (1, 0, 2)


def test_sql_functions(spark):
    X.register_sql_functions(spark, ["EMAIL", "IPV4"])
    r = spark.sql("SELECT quillfold_deidentify('x a@b.example 10.0.0.1') AS t, quillfold_pii_count('x a@b.example 10.0.0.1') AS n").first()
    assert (r.t, r.n) == ("x [EMAIL] [IPV4]", 2)


def test_stream_into_sink(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([("1", "a@b.example"), ("2", "x")], "event_id string, text string").write.json(src)
    stream = E.deidentified(spark.readStream.schema("event_id string, text string").json(src), "text", ["EMAIL"])
    E.write_stream(stream, out, cp).awaitTermination()
    read = lambda: sorted(r.text for r in spark.read.parquet(f"{out}/batch=*").collect())
    assert read() == ["[EMAIL]", "x"]
    E.BatchSink(out)(spark.createDataFrame([("9", "replayed")], "event_id string, text string"), 0)
    assert read() == ["[EMAIL]", "x"]
    with pytest.raises(ValueError):
        E.BatchSink(out, "another").check(spark)


def test_chunks_are_carried(spark, tmp_path):
    src = str(tmp_path / "chunks")
    rows = [("d", 0, "One. Two wor", False), ("d", 1, "ds. Three", False), ("d", 2, " end.", True)]
    spark.createDataFrame(rows, "doc_id string, seq long, text string, last boolean").coalesce(1).write.parquet(src)
    stream = E.carry_chunks(spark.readStream.schema("doc_id string, seq long, text string, last boolean").parquet(src), most=12)
    q = stream.writeStream.format("memory").queryName("carried").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = [r.text for r in spark.table("carried").orderBy("seq").collect()]
    assert "".join(got) == "One. Two words. Three end." and all(len(t) <= 12 for t in got)


def test_stream_windows_agree_with_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src = str(tmp_path / "ev")
    ev.orderBy("ts").coalesce(1).write.parquet(src)
    s = spark.readStream.schema(ev.schema).parquet(src)
    q = E.tumbling(s, "1 day", "event_type", watermark="1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, E.tumbling(ev, "1 day", "event_type").collect()))
    assert E.deduplicated(ev.union(ev), ["ts", "event_type", "value"]).count() <= ev.count()
    assert E.sessions(ev, "6 hours", "event_type").agg(F.sum("n")).first()[0] == ev.count()
