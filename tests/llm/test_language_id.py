from pyspark.sql import functions as F

from quillfold.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs.where(~li.held_out("doc_id")))
    out = li.predict(docs, model).where(li.held_out("doc_id"))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert out.where("rejected").count() <= 0.01 * out.count()
    low, high = out.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_held_out_is_a_checksum(spark):
    import zlib

    got = spark.range(50).select("id", li.held_out("id").alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in got]


def test_edge_rows(spark):
    learn = spark.createDataFrame([("a", "the cat sat on the mat and the dog " * 9), ("b", "le chat est sur la table avec un chien " * 9), (None, "x"), ("a", None), ("b", "")], "lang string, text string")
    model = li.fit(learn.union(learn))
    assert sorted(model) == ["a", "b"]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "THE DOG sat on the mat"), (5, "le chien est sur la table " * 3000), (4, "THE DOG sat on the mat")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in li.predict(docs, model).collect()]
    assert sorted(got) == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "a", False), (4, "a", False), (5, "b", False)]
    assert li.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in li.predict(docs, li.fit(learn.limit(0))).collect()} == {"und"}
    assert li.classify("the dog", tuple(sorted({"a": model["a"], "c": model["a"]}.items())))[2]  # no margin: rejected


def test_predictions_agree_with_plain_compression(spark, sf):
    """The query's rows against compressors made here, from the whole texts that the model holds."""
    import zstandard as zstd

    from quillfold.llm.queries import op6_language_id

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = li.fit(docs.where(~li.held_out("doc_id")))
    learned = {}
    for r in docs.where(~li.held_out("doc_id")).where("lang IS NOT NULL").select("lang", F.lower("text").alias("t")).collect():
        learned.setdefault(r.lang, set()).add(r.t)
    for lang, data in model.items():  # whole texts, each once
        left = data.decode()
        for t in sorted((t for t in learned[lang] if t and t in left), key=len, reverse=True):
            left = left.replace(t, "", 1)
        assert not left.strip("\n") and len(data) <= li.DICTIONARY
    params = zstd.ZstdCompressionParameters(compression_level=3, window_log=18, hash_log=17, chain_log=16, search_log=4, min_match=3, strategy=zstd.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(text, data):
        raw, out = text.lower().encode(), 0
        for at in range(0, len(raw), 2048):
            held = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            out += len(zstd.ZstdCompressor(dict_data=held, compression_params=params).compress(raw[at : at + 2048]))
        return out

    got = {r.doc_id: r for r in op6_language_id(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text or "") > 20_000:
            continue  # the plain way loads every dictionary anew for each piece
        letters = any(c.isalpha() for c in r.text or "")
        want = min((size(r.text, data), lang) for lang, data in model.items())[1] if letters else "und"
        assert got[r.doc_id].lang_pred == want


def test_what_is_no_letter(spark):
    model = {"a": b"the cat sat on the mat", "b": b"le chat est sur la table"}
    rows = [(1, "\u00bd \u00b2 \u2167"), (2, "12 \U0001f642"), (3, "\u00aa")]
    got = {r.doc_id: r.lang_pred for r in li.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == "und" and got[3] in "ab"


def test_narrow_margins_and_clashing_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs.where(~li.held_out("doc_id")))
    some = docs.select("doc_id", "text", "lang", F.lit("s").alias("score"), F.lit("f").alias("_Found"), F.lit(1).alias("lang_pred"))
    out = li.known(some, model)
    assert out.columns == some.columns and out.select("score", "_Found", "lang_pred").distinct().collect() == [("s", "f", 1)]
    clean = docs.where("lang IS NOT NULL AND n_chars >= 100")
    kept = li.known(clean, model).count()
    assert kept >= 0.99 * clean.count()
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["\u03b1\u03b2\u03b3 \u03b4\u03b5 " * 20, "\u4e2d\u6587\u5b57 " * 30, "qxz qvx zzk wqx " * 2, "x", "7 q"])], "doc_id long, text string")
    assert li.known(odd.withColumn("lang", F.lit(None).cast("string")), model).count() <= 1
    long = li.fit(spark.createDataFrame([("a", "x y " * 50_000), ("b", "short text")], "lang string, text string"))
    assert sorted(long) == ["a", "b"] and len(long["a"]) == 200_000  # no text of the language fits: its shortest, whole
