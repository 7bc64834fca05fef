"""Entities, relations and candidates as tables: filters, what may be exported, reports without surfaces, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import quoted, unused


def keep(spans: DataFrame, labels: list[str] | None = None, least: float = 0.0, floors: dict[str, float] | None = None) -> DataFrame:
    """Spans of the labels (all, if None) whose score reaches their label's floor, else ``least``. No score is no pass."""
    table = [F.lit(x) for kv in (floors or {}).items() for x in kv]
    floor = F.coalesce(F.try_element_at(F.create_map(*table), F.col("label")), F.lit(float(least))) if table else F.lit(float(least))
    rows = spans if labels is None else spans.where(F.col("label").isin(*labels))
    return rows.where(F.col("score") >= floor)


def exportable(span: DataFrame) -> Column:
    """Whether a span states a finding of the patient that holds: present, not of a relative, not hypothetical. Axes that
    the table lacks, or that are null, take their defaults."""
    rule = F.lit(True)
    for axis, good in {"negation": ("affirmed",), "experiencer": ("patient",), "temporality": ("recent", "historical"), "certainty": ("certain", "probable")}.items():
        if axis in span.columns:
            rule = rule & F.coalesce(quoted(axis), F.lit(good[0])).isin(*good)
    return rule


def asserted_relations(relations: DataFrame, spans: DataFrame) -> DataFrame:
    """Relations (doc_id, head, tail, ...) both of whose ends are exportable spans (doc_id, id, ...)."""
    good = spans.where(exportable(spans)).select(F.col("doc_id").alias("_d"), F.col("id").alias("_i")).distinct()
    out = relations
    for end in ("head", "tail"):
        out = out.join(good, (out["doc_id"] == good["_d"]) & (out[end] == good["_i"]), "left_semi")
    return out


def top_candidates(candidates: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` candidates of each key, with their rank; the rest are told by ``n_candidates``."""
    w = Window.partitionBy(*key)
    return candidates.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("n_candidates", F.count("*").over(w)).where(F.col("rank") <= most)


def sample_rows(df: DataFrame, key: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, those with the least digests of seed and key: the same rows whatever the partitioning."""
    (digest,) = unused(df, "_digest")
    held = [x for k in key for x in (F.lit("\x1f"), F.coalesce(quoted(k).cast("string"), F.lit("")))]
    return df.withColumn(digest, F.sha2(F.concat(F.lit(str(seed)), *held).cast("binary"), 256)).orderBy(digest, *map(quoted, key)).limit(most).drop(digest)


def audit(spans: DataFrame) -> DataFrame:
    """doc_id, label, action, n, chars, digest: what was done to a document, without any surface; the digest tells two runs
    apart and follows from places, labels and actions alone."""
    place = F.struct("start", "end")
    listed = F.transform(F.array_sort(F.collect_list(place)), lambda p: F.concat_ws("-", p["start"].cast("string"), p["end"].cast("string")))
    return spans.groupBy("doc_id", "label", "action").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("digest"))


def preview(spans: DataFrame, around: int = 0) -> DataFrame:
    """doc_id, start, end, label, action, shape: letters as a or A, digits as 9, so that a reviewer sees kinds and no values."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("surface", "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return spans.select("doc_id", "start", "end", "label", "action", shape.alias("shape"))


def members(codes: DataFrame, value_set: DataFrame, system: str = "system", code: str = "code") -> DataFrame:
    """The rows whose (system, code) is in the value set: included and not excluded. ``value_set`` has system, code, and
    exclude (boolean); an include without a code takes its whole system."""
    (s, c) = unused(codes, "_vs_system", "_vs_code")
    entry = value_set.select(F.col("system").alias(s), F.col("code").alias(c), F.coalesce("exclude", F.lit(False)).alias("exclude")).distinct()
    same = quoted(system) == F.col(s)
    exact = same & (quoted(code) == F.col(c))
    whole = entry.where(~F.col("exclude") & F.col(c).isNull()).select(s)
    some = entry.where(~F.col("exclude") & F.col(c).isNotNull()).select(s, c)
    out = entry.where(F.col("exclude")).select(s, c)
    tagged = codes.join(out, exact, "left_anti")
    named = tagged.join(some, exact, "left_semi")
    return named.unionByName(tagged.join(some, exact, "left_anti").join(whole, same, "left_semi"))
