"""Policies over spans: calibration, routing, custom terms, strength, comparison, consent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import unused

#: Actions from weak to strong.
STRENGTH = ("keep", "shift", "generalize", "mask", "hash", "replace", "remove")


def calibrated(score: Column | str, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (raw, calibrated) breakpoints, clamped to the first and last."""
    s, pts = F.col(score) if isinstance(score, str) else score, sorted(points)
    if not pts:
        raise ValueError("breakpoints are needed")
    out = F.lit(float(pts[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(pts, pts[1:]))):
        out = F.when(s <= x1, y0 + (s - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
    return F.when(s <= pts[0][0], F.lit(float(pts[0][1]))).otherwise(out)


def fit_isotonic(scored: DataFrame, score: str, truth: str) -> list[tuple[float, float]]:
    """Breakpoints of an isotonic fit; the model is bounded by the distinct scores' violators, pooled."""
    from pyspark.ml.regression import IsotonicRegression

    rows = scored.groupBy(F.round(F.col(score), 3).alias("features")).agg(F.avg(F.col(truth).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    m = IsotonicRegression(weightCol="weight").fit(rows)
    return list(zip(m.boundaries.toArray().tolist(), m.predictions.toArray().tolist()))


def strength(action: Column | str) -> Column:
    """Place of an action in the order; 0 for unknown ones."""
    return F.array_position(F.array(*(F.lit(a) for a in STRENGTH)), F.col(action) if isinstance(action, str) else action).cast("int")


def strongest(actions: DataFrame, key: list[str], action: str = "action") -> DataFrame:
    """The strongest action asked for by any policy."""
    return actions.groupBy(*key).agg(F.max_by(action, strength(action)).alias("action"))


def weakest_sufficient(options: DataFrame, key: list[str], residual: str, limit: float, action: str = "action") -> DataFrame:
    """Minimum necessary: the weakest action whose residual risk is within the limit, else ``remove``."""
    ok = F.col(residual) <= limit
    return options.groupBy(*key).agg(F.coalesce(F.min_by(F.when(ok, F.col(action)), F.when(ok, strength(action))), F.lit("remove")).alias("action"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """label, before, after, change of two action tables: added, removed, stronger, weaker."""
    b, a = before.select("label", F.col("action").alias("before")), after.select("label", F.col("action").alias("after"))
    both = b.join(a, "label", "full").where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(strength("after") > strength("before"), "stronger").otherwise("weaker")
    return both.withColumn("change", change)


def lint(policy: DataFrame, required: list[str]) -> list[str]:
    """Unknown actions, labels stated twice with different actions, required labels left out or kept."""
    rows = policy.groupBy("label").agg(F.collect_set("action").alias("actions")).collect()  # a row for each label of a policy
    found = {r["label"]: r["actions"] for r in rows}
    wrong = [f"{k}: unknown action" for k, v in found.items() if set(v) - set(STRENGTH)]
    wrong += [f"{k}: several actions" for k, v in found.items() if len(v) > 1]
    wrong += [f"{k}: required" for k in required if found.get(k) in (None, ["keep"])]
    return sorted(wrong)


def consented(rows: DataFrame, consent: DataFrame, subject: str, use: str) -> DataFrame:
    """Rows of subjects who allow this use and have not withdrawn. ``consent`` has subject, use, allowed."""
    yes = consent.where(F.col("use") == use).groupBy("subject").agg(F.bool_and("allowed").alias("ok")).where("ok").select(F.col("subject").alias("_s"))
    return rows.join(yes, F.col(subject) == F.col("_s"), "left_semi")


def cascade(docs: DataFrame, cheap: Callable[[DataFrame], DataFrame], dear: Callable[[DataFrame], DataFrame], floor: float, id_col: str = "doc_id") -> DataFrame:
    """Spans of two detectors with their stage (cheap, dear); the dear one runs where the cheap one settles nothing.

    A document is settled if it has cheap spans and all of them reach the floor. All others go to the dear detector, those
    without any cheap span among them. Spans of both stages are given out, for arbitration. A null id is an id like
    others; rows that share an id are settled together. The plan reads the cheap spans twice, so a costly ``cheap`` is
    best written to a table first.
    """
    settled, known = unused(docs, "_settled", "_known")
    first = cheap(docs)
    sure = first.groupBy(F.col("doc_id").alias(known)).agg((F.min("score") >= floor).alias(settled)).where(settled)
    rest = docs.join(sure, docs[id_col].eqNullSafe(sure[known]), "left_anti")
    return first.withColumn("stage", F.lit("cheap")).unionByName(dear(rest).withColumn("stage", F.lit("dear")), allowMissingColumns=True)


def custom_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, label of denied literal words in texts, those also allowed left out.

    ``terms`` has term, label, allowed. Words meet by equality, so the table may be of any size.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.split(F.lower(text_col), "[^a-z0-9_]+"))).alias("term"))
    listed = terms.select(F.lower("term").alias("term"), "label", "allowed")
    deny = listed.where("NOT allowed").select("term", "label").distinct()
    allow = listed.where("allowed").select("term").distinct()
    return words.join(deny.join(allow, "term", "left_anti"), "term")


def injection_risk(text: Column | str) -> Column:
    """Whether a text tries to instruct a reader's tools: a few fixed phrasings."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return low.rlike(r"ignore (?:all |any )?(?:previous|prior|above) (?:instructions|prompts)|disregard (?:the )?(?:system|previous) (?:prompt|instructions)|you are now [a-z]+|reveal (?:your|the) (?:system )?prompt")
