"""Clinical structures over tables: trends, timelines, flowsheets, problem lists, linked mentions, interaction checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import SMALL_SIDE, quoted, spool, unused


def folded(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), "[ \t]+", " ")


def trend(points: DataFrame, entity: str, when: str, value: str, unit: str | None = None) -> DataFrame:
    """entity, n, first, last, delta, direction: up, down, mixed, flat, or unknown.

    Only points of the entity's most frequent unit count (of ties the first by name). Two values at one time make the
    direction unknown. Steps within 1e-9 of the larger value, or 1e-12, are flat.
    """
    p = points.select(folded(entity).alias("entity"), F.col(when).alias("t"), F.col(value).cast("double").alias("v"), (F.col(unit) if unit else F.lit("")).alias("u"))
    counts = p.groupBy("entity", "u").agg(F.count("*").alias("n"))
    modal = counts.groupBy("entity").agg(F.min_by("u", F.struct(-F.col("n"), F.col("u"))).alias("u"))
    p = p.join(modal, ["entity", "u"]).where("t IS NOT NULL AND v IS NOT NULL").groupBy("entity", "t").agg(F.min("v").alias("v"), F.max("v").alias("w"), F.count("*").alias("k"))
    prev = F.lag("v").over(Window.partitionBy("entity").orderBy("t"))
    step, slack = F.col("v") - prev, F.greatest(F.lit(1e-12), 1e-9 * F.greatest(F.abs(prev), F.abs("v")))
    p = p.withColumn("s", F.when(F.abs(step) <= slack, 0).otherwise(F.signum(step)))
    g = p.groupBy("entity").agg(F.sum("k").alias("n"), F.min_by("v", "t").alias("first"), F.max_by("v", "t").alias("last"), F.count_if(F.col("s") > 0).alias("ups"), F.count_if(F.col("s") < 0).alias("downs"), F.count_if(F.col("v") != F.col("w")).alias("conflicts"), F.count("*").alias("times"))
    direction = F.when((F.col("conflicts") > 0) | (F.col("times") < 2), "unknown").when((F.col("ups") > 0) & (F.col("downs") > 0), "mixed").when(F.col("ups") > 0, "up").when(F.col("downs") > 0, "down").otherwise("flat")
    return g.select("entity", "n", "first", "last", (F.col("last") - F.col("first")).alias("delta"), direction.alias("direction"))


def timeline(events: DataFrame, subject: str, key: str, when: str, assertion: str | None = None) -> DataFrame:
    """One row for each (subject, folded key, time, assertion) with its place in the subject's order; undated rows trail."""
    e = events.select(F.col(subject).alias("subject"), folded(key).alias("key"), F.col(when).alias("at"), (F.col(assertion) if assertion else F.lit("affirmed")).alias("assertion"))
    e = e.groupBy("subject", "key", "at", "assertion").agg(F.count("*").alias("mentions"))
    return e.withColumn("place", F.dense_rank().over(Window.partitionBy("subject").orderBy(F.col("at").asc_nulls_last())))


def flowsheet(points: DataFrame, row: Column, column: str, names: list[str], value: str) -> DataFrame:
    """A grid: a row for each time, a column for each parameter, holding the mean of its values."""
    return points.withColumn("slot", row).groupBy("slot").pivot(column, names).agg(F.round(F.avg(value), 6))


def parse_flowsheet(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, parameter, time, value of pipe-delimited grids: the first line holds times, each other line a parameter."""
    lines = F.filter(F.split(text_col, "\n"), lambda x: F.length(F.trim(x)) > 0)
    cells = lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c))
    t = texts.select(F.col(id_col).alias("id"), F.transform(lines, cells).alias("g")).where("size(g) > 1")
    rows = t.select("id", F.element_at("g", 1).alias("times"), F.explode(F.slice("g", 2, 10_000)).alias("r"))
    out = rows.select("id", F.element_at("r", 1).alias("parameter"), F.posexplode(F.arrays_zip(F.slice("times", 2, 10_000).alias("time"), F.slice("r", 2, 10_000).alias("value"))).alias("k", "c"))
    return out.select("id", "parameter", "c.time", "c.value").where("length(value) > 0")


#: Which status stands when several are stated.
STATUS = ("active", "inactive", "unconfirmed", "refuted")


def problem_list(mentions: DataFrame, subject: str = "subject") -> DataFrame:
    """One row for each problem: by coreference id, else by code, else by text; uncoded never joins coded.

    Mentions have subject, text, system, code, coref, status, offset.
    """
    key = F.when(F.col("coref").isNotNull(), F.concat(F.lit("r:"), "coref")).when(F.col("code").isNotNull(), F.concat(F.lit("c:"), F.coalesce("system", F.lit("")), F.lit("|"), "code")).otherwise(F.concat(F.lit("t:"), folded("text")))
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in STATUS)), F.col("status")), F.lit(len(STATUS)))
    g = mentions.withColumn("problem", key).groupBy(F.col(subject).alias("subject"), "problem")
    return g.agg(F.min_by("status", F.struct(rank, "offset")).alias("status"), F.min_by("text", "offset").alias("text"), F.count("*").alias("mentions"), F.min("offset").alias("first_offset"))


def reconcile_assertions(mentions: DataFrame, key: list[str], axes: list[str]) -> DataFrame:
    """One row for each key: the axis value if its mentions agree, else null; status unconfirmed on any conflict."""
    g = mentions.where(F.coalesce(F.col("experiencer"), F.lit("patient")) == "patient").groupBy(*key)
    out = g.agg(*(F.when(F.count_distinct(a) <= 1, F.min(a)).alias(a) for a in axes), F.greatest(*(F.count_distinct(a) for a in axes), F.lit(0)).alias("_most"))
    return out.withColumn("status", F.when(F.col("_most") > 1, "unconfirmed").otherwise("confirmed")).drop("_most")


def link_attributes(heads: DataFrame, attributes: DataFrame, segment: list[str]) -> DataFrame:
    """Each attribute with its nearest head of the same segment (sentence, line, clause, section); ties go to the earlier."""
    h = heads.select(*segment, F.col("start").alias("head_start"), F.col("end").alias("head_end"), F.col("id").alias("head_id"))
    gap = F.greatest(F.col("start") - F.col("head_end"), F.col("head_start") - F.col("end"), F.lit(0))
    both = attributes.join(h, segment).withColumn("distance", gap)
    order = Window.partitionBy("id").orderBy("distance", "head_start", "head_id")
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def interaction_pairs(drugs: DataFrame, reference: DataFrame, subject: str, code: str) -> DataFrame:
    """Known interactions among a subject's distinct drugs. ``reference`` is (a, b, severity), in either order."""
    d = drugs.where(F.col(code).isNotNull()).select(F.col(subject).alias("subject"), F.col(code).alias("code")).distinct()
    pairs = d.select("subject", F.col("code").alias("a")).join(d.select("subject", F.col("code").alias("b")), "subject").where("a < b")
    r = reference.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "severity")
    return pairs.join(F.broadcast(r) if reference.isLocal() else r, ["a", "b"])


def dose_check(doses: DataFrame, limits: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """check: within, below, above, or not_checked where the limits lack the drug. ``limits`` has keys, low, high."""
    out = doses.join(limits, keys, "left")
    check = F.when(F.col("low").isNull() & F.col("high").isNull(), "not_checked").when(F.col(amount) < F.col("low"), "below").when(F.col(amount) > F.col("high"), "above").otherwise("within")
    return out.withColumn("check", check).drop("low", "high")


def noisy_or(relations: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The document's score of a relation: 1 - prod(1 - s), six decimals."""
    return relations.groupBy(*keys).agg(F.round(1 - F.aggregate(F.array_sort(F.collect_list(score)), F.lit(1.0), lambda a, s: a * (1 - s)), 6).alias("score"), F.count("*").alias("sentences"))


def panels(results: DataFrame, members: DataFrame, at: list[str], analyte: str) -> DataFrame:
    """Results gathered into panels: at, panel, analytes (sorted), complete. ``members`` is (panel, analyte)."""
    m = members.select("panel", F.lower("analyte").alias("_a"))
    size = members.groupBy("panel").agg(F.count_distinct(F.lower("analyte")).alias("size"))
    got = results.join(m, F.lower(F.col(analyte)) == F.col("_a")).groupBy(*at, "panel").agg(F.array_sort(F.collect_set("_a")).alias("analytes"))
    return got.join(size, "panel").select(*at, "panel", "analytes", (F.size("analytes") == F.col("size")).alias("complete"))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, start, end of headed sections; a section ends where the next begins."""
    from ..functions.clinical import section_label

    lines = F.split(text_col, "\n")
    starts = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + F.char_length(x) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text_col).alias("n"), F.explode(F.arrays_zip(lines.alias("line"), starts.alias("start"))).alias("x")).select("id", "n", section_label("x.line").alias("label"), "x.start").where("label IS NOT NULL")
    return rows.select("id", "label", "start", F.coalesce(F.lead("start").over(Window.partitionBy("id").orderBy("start")), F.col("n")).alias("end"))


def spans_in_sections(spans: DataFrame, found: DataFrame) -> DataFrame:
    """Spans with the section they begin in, by one ordered pass over both; null before the first header."""
    s = found.select(F.col("id").alias("doc_id"), F.col("start").alias("p"), F.lit(0).alias("k"), F.col("label").alias("open"), F.lit(None).cast("long").alias("sid"))
    q = spans.select("doc_id", F.col("start").alias("p"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("open"), F.col("span_id").alias("sid"))
    last = F.last("open", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0))
    return s.unionByName(q).withColumn("section", last).where("k = 1").select("doc_id", F.col("sid").alias("span_id"), "section")


def parsed(rows: DataFrame, text_col: str, parser: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` and, under ``name``, what the parser makes of each text. Phrases recur: where there are few enough distinct
    ones for every task to hold, each is parsed once and looked up; where there are more, each row's own is parsed."""
    (key,) = unused(rows, "_phrase")
    known = spool(rows.select(quoted(text_col).alias(key)).distinct())
    if known.count() > SMALL_SIDE:
        return rows.withColumn(name, parser(quoted(text_col)))
    made = spool(known.withColumn(name, parser(F.col(key))))
    return rows.join(F.broadcast(made), quoted(text_col).eqNullSafe(F.col(key)), "left").drop(key)
