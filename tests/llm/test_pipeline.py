from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillfold.llm import language_id as li

from .test_decontaminate import brute as contaminated
from .test_minhash import brute as groups
from .test_packing import check
from .test_secrets import sx


def test_stages_agree_with_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, outs = {}, {}
    for name, stage in cp.STAGES:
        outs[name] = docs
        docs = cp.spool(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == outs[name].columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r.doc_id: r.text for r in outs["language_id"].collect()}
    model = tuple(sorted(li.fit(outs["language_id"].where(~li.held_out("doc_id"))).items()))
    want = {i: t for i, t in before.items() if not li.classify(t, model)[2]}
    assert kept["language_id"] == want and len(want) > 0.98 * len(before)
    found = groups(list(want.items()), 5)
    want = {i: t for i, t in want.items() if found[i][1] == i}
    assert kept["near_duplicates"] == want
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    bad = {r[0] for r in contaminated(list(want.items()), items) if r[-1]}
    want = {i: t for i, t in want.items() if i not in bad}
    assert bad and kept["decontamination"] == want
    want = {i: sx.masked(t, sx.find_secrets(t)) for i, t in want.items()}
    assert kept["secrets"] == want
    check(list(want.items()), type("Packed", (), {"placed": docs}))
    assert sorted(map(str, cp.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_edge_rows(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf " * 3
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, None, "en", None, None), (3, "", None, "s", 0), (4, text + "!", None, "s", 9), (None, text, "en", "s", 1), (6, "le petit chat noir dort sur la table du salon avec son ami le chien " * 4, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "entirely different words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "6", "None"]
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path / "empty")).count() == 0


def test_clashing_names_travel_through_every_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["_found", "Score", "lang_pred", "rejected", "_hit_id", "_Hit_Key", "hit_id", "hit_key", "gone", "_Doc", "text_key", "key", "n_shingles", "component_id", "spans", "items", "u", "v"]
    clash = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    (tmp_path / "d").mkdir()
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "d" / "benchmark.parquet"))
    plain = clash_docs = None
    plain, clash_docs = docs, clash
    for name, stage in cp.STAGES:
        plain, clash_docs = cp.spool(stage(spark, plain, sf)), cp.spool(stage(spark, clash_docs, str(tmp_path / "d")))
        if name != "packing":
            assert clash_docs.columns == clash.columns
            assert sorted(map(str, clash_docs.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
            assert clash_docs.where(" OR ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0
