"""Span annotations in standoff and token formats, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_standoff(files: DataFrame, id_col: str = "doc_id", text_col: str = "ann") -> DataFrame:
    """doc_id, span_id, label, start, end, surface of ``T`` lines; of a discontinuous span, one row for each fragment."""
    lines = files.select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, "\r?\n")).alias("line")).where(F.col("line").startswith("T"))
    parts = lines.select("doc_id", F.split("line", "\t", 3).alias("p")).where("size(p) = 3")
    head = F.split(F.get("p", F.lit(1)), " ", 2)
    rows = parts.select("doc_id", F.get("p", F.lit(0)).alias("span_id"), F.get(head, F.lit(0)).alias("label"), F.explode(F.split(F.get(head, F.lit(1)), ";")).alias("at"), F.get("p", F.lit(2)).alias("surface"))
    pos = F.split("at", " ")
    return rows.select("doc_id", "span_id", "label", F.get(pos, F.lit(0)).try_cast("int").alias("start"), F.get(pos, F.lit(1)).try_cast("int").alias("end"), "surface").where("start IS NOT NULL AND end >= start")


def write_standoff(spans: DataFrame) -> DataFrame:
    """doc_id, ann: a standoff file for each document, spans numbered by start, end and label."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "label"))
    line = F.concat(F.lit("T"), n.cast("string"), F.lit("\t"), "label", F.lit(" "), F.col("start").cast("string"), F.lit(" "), F.col("end").cast("string"), F.lit("\t"), F.translate("surface", "\n\t", "  "))
    rows = spans.select("doc_id", F.struct(n.alias("n"), line.alias("line")).alias("r"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("ann"))


def decode_bio(tokens: DataFrame) -> DataFrame:
    """doc_id, label, start, end of runs of tags. Tokens are (doc_id, pos, start, end, tag); B, I, E, S and O are known.

    A run begins at B or S, and at I or E that follows another label or none.
    """
    t = tokens.withColumn("label", F.when(F.col("tag") != "O", F.substring("tag", 3, 1000))).withColumn("kind", F.substring("tag", 1, 1))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before_label, before_kind = F.lag("label").over(order), F.lag("kind").over(order)
    new = F.col("label").isNotNull() & (F.col("kind").isin("B", "S") | ~F.col("label").eqNullSafe(before_label) | before_kind.isin("E", "S"))
    t = t.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("label IS NOT NULL")
    return t.groupBy("doc_id", "run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def encode_bio(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tag of each token (doc_id, pos, start, end): B at a span's first token, I inside, O elsewhere; spans are disjoint."""
    s = spans.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("label").alias("_l"))
    hit = tokens.join(s, (tokens["doc_id"] == s["_d"]) & (tokens["start"] < s["_e"]) & (tokens["end"] > s["_s"]), "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "_s").orderBy("pos")) == 1
    tag = F.when(F.col("_l").isNull(), "O").when(first, F.concat(F.lit("B-"), "_l")).otherwise(F.concat(F.lit("I-"), "_l"))
    return hit.withColumn("tag", tag).drop("_d", "_s", "_e", "_l")


def read_conll(files: DataFrame, id_col: str = "doc_id", text_col: str = "conll") -> DataFrame:
    """doc_id, pos, token, tag, start, end, sentence; a blank line ends a sentence, tokens are one space apart."""
    lines = files.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\r?\n")).alias("line_no", "line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines.withColumn("sentence", F.sum((F.trim("line") == "").cast("int")).over(order)).where(F.trim("line") != "")
    cols = F.split(F.trim("line"), "[ \t]+")
    t = lines.select("doc_id", "line_no", "sentence", F.element_at(cols, 1).alias("token"), F.element_at(cols, -1).alias("tag"))
    before = F.coalesce(F.sum(F.char_length("token") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("start", before.cast("int")).withColumn("end", (before + F.char_length("token")).cast("int")).withColumn("pos", F.row_number().over(order)).drop("line_no")


def write_conll(tokens: DataFrame) -> DataFrame:
    """doc_id, conll of (doc_id, pos, token, tag, sentence)."""
    row = F.struct("pos", "sentence", F.concat("token", F.lit(" "), "tag").alias("line"))
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    joined = F.aggregate("r", F.struct(F.lit("").alias("out"), F.lit(-1).cast("long").alias("s")), lambda a, r: F.struct(F.concat(a["out"], F.when((a["s"] >= 0) & (a["s"] != r["sentence"]), "\n").otherwise(""), r["line"], F.lit("\n")).alias("out"), r["sentence"].cast("long").alias("s")), lambda a: a["out"])
    return rows.select("doc_id", joined.alias("conll"))
