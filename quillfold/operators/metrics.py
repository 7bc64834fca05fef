"""Evaluation: span and relation scores, agreement, drift, significance, leakage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import quoted, spool, unused

EPSILON = 1e-6
#: Ranges into which an order is cut, so that running sums need no single task.
RANGES = 256


def running_sums(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` (one for each value of ``order``) with ``before_<c>``: the sum of c over all smaller values.

    Values are dealt into ranges by approximate quantiles; a range's own running sum is added to the total of the ranges
    before it, of which there are at most ``RANGES``. The result is exact whatever the quantiles are.
    """
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 2000)).first()[0] or []))
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_range", place)
    totals = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most RANGES rows
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_t_{c}") for c in columns))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), "_range")
    return out.select(*rows.columns, *((F.col(f"_t_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in columns))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    return [F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1")]


def exact_span_scores(gold: DataFrame, pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of spans that agree on document, start, end and label."""
    key = ["doc_id", "start", "end", "label"]
    g, p = (d.select(*key).distinct().withColumn(n, F.lit(1)) for d, n in ((gold, "g"), (pred, "p")))
    both = g.join(p, key, "full")
    n = lambda rule: F.count_if(rule)
    out = both.groupBy(*(by or [])).agg(n(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), n(F.col("g").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))
    return out.select(*(by or []), "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def relaxed_span_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """label, gold, pred, gold_hit, pred_hit, precision, recall, f1: a span is hit if one of its label on the other side
    overlaps it. Equal spans count once."""
    key = ["doc_id", "start", "end", "label"]
    g, p = (d.select(*key).distinct() for d in (gold, pred))

    def hits(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        o = b.select(F.col("doc_id").alias("_d"), F.col("label").alias("_l"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        met = a.join(o, (a["doc_id"] == o["_d"]) & (a["label"] == o["_l"]) & (a["start"] < o["_e"]) & (a["end"] > o["_s"]), "left_semi")
        counted = a.groupBy("label").agg(F.count("*").alias(name))
        return counted.join(met.groupBy("label").agg(F.count("*").alias(f"{name}_hit")), "label", "left")

    both = hits(g, p, "gold").join(hits(p, g, "pred"), "label", "full").fillna(0, ["gold", "pred", "gold_hit", "pred_hit"])
    return both.select("label", "gold", "pred", "gold_hit", "pred_hit", *_from_rates(F.col("pred_hit") / F.nullif("pred", F.lit(0)), F.col("gold_hit") / F.nullif("gold", F.lit(0))))


def _from_rates(p: Column, r: Column) -> list[Column]:
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1")]


def char_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """label, gold, pred, shared (characters), precision, recall, f1. Spans of one side and label must not overlap."""
    p = pred.select(F.col("doc_id").alias("_d"), F.col("label").alias("_l"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    both = gold.join(p, (gold["doc_id"] == p["_d"]) & (gold["label"] == p["_l"]) & (gold["start"] < p["_e"]) & (gold["end"] > p["_s"]))
    shared = both.groupBy("label").agg(F.sum(F.least("end", "_e") - F.greatest("start", "_s")).alias("shared"))
    size = lambda d, n: d.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias(n))
    out = size(gold, "gold").join(size(pred, "pred"), "label", "full").join(shared, "label", "left").fillna(0, ["gold", "pred", "shared"])
    return out.select("label", "gold", "pred", "shared", *_from_rates(F.col("shared") / F.nullif("pred", F.lit(0)), F.col("shared") / F.nullif("gold", F.lit(0))))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t: with t = sqrt(df) * tan(a) its density is a power of the cosine."""
    import numpy as np

    if not (math.isfinite(t) and df > 0):
        return float("nan")
    a0 = math.atan(abs(t) / math.sqrt(df))
    area = lambda lo: float(np.trapezoid(np.cos(x := np.linspace(lo, math.pi / 2, 200_001)) ** (df - 1), x))
    return min(1.0, area(a0) / area(0.0))


def welch_test(rows: DataFrame, value: str, group: str, base: str, other: str) -> DataFrame:
    """n, mean and variance of both groups, t, df and two-sided p of a difference of means; variances may differ."""
    stats = rows.where(F.col(group).isin(base, other)).groupBy(F.col(group).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    found = {r["g"]: r for r in stats.collect()}  # two rows
    if len(found) < 2 or min(r["n"] for r in found.values()) < 2:
        raise ValueError("both groups need two values or more")
    a, b = found[base], found[other]
    ea, eb = a["v"] / a["n"], b["v"] / b["n"]
    t = (b["m"] - a["m"]) / math.sqrt(ea + eb) if ea + eb else math.nan
    df = (ea + eb) ** 2 / (ea**2 / (a["n"] - 1) + eb**2 / (b["n"] - 1)) if ea + eb else math.nan
    row = (a["n"], b["n"], a["m"], b["m"], t, df, student_p(t, df))
    return rows.sparkSession.createDataFrame([row], "base_n long, other_n long, base_mean double, other_mean double, t double, df double, p double")


def char_leakage(gold: DataFrame, redacted: DataFrame) -> DataFrame:
    """For each label: gold characters, those inside no redacted span, and their share.

    Redacted spans of a document must not overlap each other (arbitrated spans don't).
    """
    inner = F.least("end", "re") - F.greatest("start", "rs")
    r = redacted.select("doc_id", F.col("start").alias("rs"), F.col("end").alias("re"))
    hit = gold.join(r, (gold["doc_id"] == r["doc_id"]) & (gold["start"] < r["re"]) & (gold["end"] > r["rs"]), "left").select(gold["doc_id"], "start", "end", "label", F.coalesce(inner, F.lit(0)).alias("in"))
    per = hit.groupBy("doc_id", "start", "end", "label").agg(F.sum("in").alias("covered"))
    out = per.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("chars"), F.sum(F.col("end") - F.col("start") - F.col("covered")).alias("leaked"))
    return out.withColumn("leakage", F.col("leaked") / F.col("chars"))


def leakage_heatmap(spans: DataFrame, row: str, column: str) -> DataFrame:
    """missed, total, leakage for every cell and margin of two keys. ``spans`` has found (boolean)."""
    return spans.cube(row, column).agg(F.count_if(~F.col("found")).alias("missed"), F.count("*").alias("total")).withColumn("leakage", F.col("missed") / F.col("total"))


def one_to_one(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn with each gold and each predicted relation used once: the lesser count of each key matches."""
    g, p = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((gold, "g"), (pred, "p")))
    both = g.join(p, keys, "full").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    return both.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def b_cubed(gold: DataFrame, pred: DataFrame, mention: str = "mention", cluster: str = "cluster") -> DataFrame:
    """precision, recall, f1 of clusterings. Counts by (gold cluster, predicted cluster) stand for the mention pairs."""
    m = gold.select(mention, F.col(cluster).alias("g")).join(pred.select(mention, F.col(cluster).alias("p")), mention)
    cells = m.groupBy("g", "p").agg(F.count("*").alias("n"))
    sizes = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"n{c}"))
    rows = cells.join(sizes("g"), "g").join(sizes("p"), "p")
    out = rows.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two raters."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    margins = cells.groupBy("a").agg(F.sum("n").alias("x")).join(cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("y")), "a").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("chance"))
    rows = total.crossJoin(margins)  # one row each
    po, pe = F.col("same") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    return rows.select(F.col("total").alias("n"), po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - F.when(pe < 1, pe).otherwise(0))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """kappa over items with any equal number of ratings."""
    cells = ratings.groupBy(item, category).agg(F.count("*").alias("n"))
    per = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).select((F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("p"), "m")
    mean = per.agg(F.avg("p").alias("p"), F.sum("m").alias("total"))
    share = cells.groupBy(category).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("sq"))
    rows = mean.crossJoin(share)  # one row each
    pe = F.col("sq") / (F.col("total") * F.col("total"))
    return rows.select(((F.col("p") - pe) / (1 - pe)).alias("kappa"))


def population_stability(base: DataFrame, now: DataFrame, bucket: str) -> DataFrame:
    """psi over the union of buckets, with a little added to both shares."""
    h = lambda d, n: d.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias(n))
    both = h(base, "a").join(h(now, "b"), "bucket", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    rows = both.crossJoin(F.broadcast(total))  # one row
    p, q = F.col("a") / F.col("ta") + EPSILON, F.col("b") / F.col("tb") + EPSILON
    return rows.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def benjamini_hochberg(tests: DataFrame, key: str, p: str, group: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """The same rows with adjusted p and rejected, within each family of tests.

    Tests of one p share their adjusted p, so families are combined to counts by p first. Those are dealt by ranges of
    (family, p), whatever a family's size: a part adds up its own counts and looks up what lies before it, and its least
    raw value and what lies after. Tests with a null p are in no family and get nulls. ``key`` is kept for ties in reports.
    """
    by = group or []
    family, part, before, after, m, c = unused(tests, "_family", "_part", "_before", "_after", "_m", "_c")
    tagged = tests.withColumn(family, F.struct(*map(quoted, by)) if by else F.struct(F.lit(0).alias("one")))
    counts = tagged.where(quoted(p).isNotNull()).groupBy(family, quoted(p).alias("p")).agg(F.count("*").alias("n"))
    dealt = spool(counts.repartitionByRange(family, "p").withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(family, part).agg(F.sum("n").alias("t"))  # a family has at most as many rows as there are parts
    parts = Window.partitionBy(family).orderBy(part)
    sums = sums.withColumn(before, F.coalesce(F.sum("t").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(m, F.sum("t").over(Window.partitionBy(family)))
    inside = Window.partitionBy(part, family).orderBy("p")
    ranked = dealt.join(sums.drop("t"), [family, part]).withColumn(c, F.col(before) + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = spool(ranked.withColumn("raw", F.col("p") * F.col(m) / F.col(c)).select(family, part, "p", "raw"))
    least = ranked.groupBy(family, part).agg(F.min("raw").alias("t")).withColumn(after, F.min("t").over(parts.rowsBetween(1, Window.unboundedFollowing)))
    back = F.min("raw").over(inside.rowsBetween(0, Window.unboundedFollowing))
    adjusted = ranked.join(least.drop("t"), [family, part]).select(F.col(family).alias("_f"), F.col("p").alias("_p"), F.least(F.lit(1.0), back, after).alias("_a"))
    out = tagged.join(adjusted, tagged[family].eqNullSafe(F.col("_f")) & (quoted(p) == F.col("_p")), "left")
    return out.select(*(quoted(x) for x in tests.columns if x.lower() not in ("adjusted", "rejected")), F.col("_a").alias("adjusted"), (F.col("_a") <= alpha).alias("rejected"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], score: str, truth: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 at each threshold, in one pass."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    rows = scored.select(score, F.col(truth).cast("boolean").alias("y"), t)
    yes = F.col(score) >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(yes & F.col("y")).alias("tp"), F.count_if(yes & ~F.col("y")).alias("fp"), F.count_if(~yes & F.col("y")).alias("fn"))
    return out.select("threshold", "tp", "fp", "fn", *_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest gap between two samples' distribution functions, from counts by value."""
    h = lambda d, n: d.groupBy(F.col(value).alias("v")).agg(F.count("*").alias(n))
    both = h(a, "a").join(h(b, "b"), "v", "full").select("v", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    ca, cb = F.col("before_a") + F.col("a"), F.col("before_b") + F.col("b")
    return running_sums(both, "v", ["a", "b"]).crossJoin(F.broadcast(total)).agg(F.max(F.abs(ca / F.col("ta") - cb / F.col("tb"))).alias("ks"))  # one row


def total_variation(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    h = lambda d, n: d.groupBy(F.col(value).alias("v")).agg(F.count("*").alias(n))
    both = h(a, "a").join(h(b, "b"), "v", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return both.crossJoin(F.broadcast(total)).agg((0.5 * F.sum(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb")))).alias("tv"))


def rank_auc(scored: DataFrame, score: str, member: str) -> DataFrame:
    """auc and advantage of a membership score: probabilities from counts by score, ties counting half."""
    h = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(member)).alias("p"), F.count_if(~F.col(member)).alias("n"))
    rows = running_sums(h, "s", ["n"]).withColumn("w", F.col("p") * (F.col("before_n") + F.col("n") / 2))
    auc = F.sum("w") / (F.sum("p") * F.sum("n"))
    return rows.agg(auc.alias("auc")).withColumn("advantage", 2 * F.col("auc") - 1)


def stragglers(shards: DataFrame, seconds: str, documents: str, multiplier: float = 2.0, minimum: int = 3) -> DataFrame:
    """Shards slower for each document than ``multiplier`` times the median, once enough are done."""
    rate = shards.withColumn("rate", F.col(seconds) / F.col(documents))
    m = rate.agg(F.percentile("rate", 0.5).alias("median"), F.count("*").alias("done"))
    return rate.crossJoin(F.broadcast(m)).where((F.col("done") >= minimum) & (F.col("rate") > multiplier * F.col("median"))).drop("done")


def table_diff(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Key and change (added, removed, changed) of two versions of a table."""
    digest = lambda d, n: d.select(*key, F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256).alias(n))
    both = digest(before, "x").join(digest(after, "y"), key, "full")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "change")


def verify_chain(log: DataFrame, chain: str, seq: str, prev: str, own: str, payload: str) -> DataFrame:
    """chain, entries, broken: entries whose digest isn't theirs, or whose link isn't the digest before."""
    before = F.lag(own).over(Window.partitionBy(chain).orderBy(seq))
    good = (F.col(own) == F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.lit("|"), payload).cast("binary"), 256)) & F.coalesce(before, F.lit("")).eqNullSafe(F.coalesce(prev, F.lit("")))
    return log.withColumn("_ok", good).groupBy(chain).agg(F.count("*").alias("entries"), F.count_if(~F.col("_ok")).alias("broken"))
