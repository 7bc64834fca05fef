"""Least generalisation that reaches k-anonymity (and l-diversity or t-closeness), with bounded suppression.

The table is collapsed once to distinct quasi-identifier tuples with counts; the lattice of level combinations is then
walked from little to much loss on that small table. A node below one that fails on suppression can't be skipped, but the
walk ends at the first that passes, since nodes come in order of loss. Beyond ``MOST_NODES`` the search is refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.generalize import ladder
from . import privacy as P

MOST_NODES = 100_000


@dataclass(frozen=True)
class Plan:
    """Levels by column, the rows suppressed, and the loss (mean share of each ladder climbed, plus the rows' share)."""

    levels: dict[str, int]
    suppressed: int
    loss: float


def leveled(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Every level of every quasi-identifier as a column ``name@level``."""
    cols = [rung(F.col(c)).alias(f"{c}@{i}") for c, kind in kinds.items() for i, rung in enumerate(ladder(kind))]
    return df.select("*", *cols)


def search(df: DataFrame, kinds: dict[str, str], k: int, most_suppressed: int = 0, l: int | None = None, t: float | None = None, sensitive: str | None = None) -> Plan:  # noqa: E741
    """The plan with the least loss; ties go to the lower levels in column order. None in reach is an error."""
    names = sorted(kinds)
    heights = {c: len(ladder(kinds[c])) - 1 for c in names}
    nodes = sorted(product(*(range(heights[c] + 1) for c in names)), key=lambda n: (sum(x / max(1, heights[c]) for c, x in zip(names, n)), n))
    if len(nodes) > MOST_NODES:
        raise ValueError("the lattice is too large")
    extra = [sensitive] if sensitive else []
    tuples = leveled(df.groupBy(*names, *extra).agg(F.count("*").alias("_n")), {c: kinds[c] for c in names}).persist()
    try:
        total = tuples.agg(F.sum("_n")).first()[0] or 0
        best: Plan | None = None
        for node in nodes:
            loss = P.information_loss(dict(zip(names, node)), heights)
            if best and loss >= best.loss:
                break
            cols = [f"{c}@{x}" for c, x in zip(names, node)]
            lost = _suppressed(tuples, cols, k, l, t, sensitive, total)
            if lost <= most_suppressed and (lost < total or not total):
                plan = Plan(dict(zip(names, node)), lost, loss + (lost / total if total else 0.0))
                best = min((p for p in (best, plan) if p), key=lambda p: (p.loss, tuple(p.levels[c] for c in names)))
        if best is None:
            raise ValueError("no generalisation is in reach")
        return best
    finally:
        tuples.unpersist()


def _suppressed(tuples: DataFrame, cols: list[str], k: int, l: int | None, t: float | None, sensitive: str | None, total: int) -> int:  # noqa: E741
    classes = tuples.groupBy(*(F.col(f"`{c}`") for c in cols))
    if l is None and t is None:
        bad = classes.agg(F.sum("_n").alias("size")).where(F.col("size") < k)
        return int(bad.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    counts = tuples.groupBy(*(F.col(f"`{c}`") for c in cols), sensitive).agg(F.sum("_n").alias("n"))
    overall = counts.groupBy(F.col(sensitive).alias("_g")).agg(F.sum("n").alias("g"))
    rows = counts.join(overall, F.col(sensitive).eqNullSafe(F.col("_g")))
    out = rows.groupBy(*(F.col(f"`{c}`") for c in cols)).agg(F.sum("n").alias("size"), F.count("*").alias("distinct"), F.collect_list(F.struct("n", "g")).alias("v"))
    q = lambda x: x["g"] / F.lit(float(total))
    tv = 0.5 * (F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x["n"] / F.col("size") - q(x)) - q(x)) + 1)
    bad = (F.col("size") < k) | (F.col("distinct") < (l or 0)) | ((tv > t + P.TOLERANCE) if t is not None else F.lit(False))
    return int(out.where(bad).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])


def apply(df: DataFrame, kinds: dict[str, str], plan: Plan, k: int, drop: list[str] | None = None, l: int | None = None, t: float | None = None, sensitive: str | None = None) -> DataFrame:  # noqa: E741
    """The released table: direct identifiers dropped, quasi-identifiers at their level, classes gone that are too small,
    or too alike or too far from the table in the sensitive column."""
    out = df.drop(*(drop or []))
    for c, level in plan.levels.items():
        out = out.withColumn(c, ladder(kinds[c])[level](F.col(c)))
    qi = list(plan.levels)
    bad = P.class_sizes(out, qi).where(F.col("size") < k).select(*qi)
    if l is not None:
        bad = bad.unionByName(P.l_diversity(out, qi, sensitive).where(F.col("distinct_l") < l).select(*qi))
    if t is not None:
        bad = bad.unionByName(P.t_closeness(out, qi, sensitive).where(F.col("t") > t + P.TOLERANCE).select(*qi))
    return P._join_classes(out, bad.distinct(), P.check_qi(out, qi), "left_anti")


def anonymize(df: DataFrame, kinds: dict[str, str], k: int, most_suppressed: int = 0, drop: list[str] | None = None, l: int | None = None, t: float | None = None, sensitive: str | None = None) -> tuple[DataFrame, Plan]:  # noqa: E741
    """The released table and its plan: k-anonymous and, where asked for, l-diverse and t-close in ``sensitive``."""
    if (l is not None or t is not None) and sensitive is None:
        raise ValueError("diversity and closeness need a sensitive column")
    plan = search(df, kinds, k, most_suppressed, l, t, sensitive)
    return apply(df, kinds, plan, k, drop, l, t, sensitive), plan


def anonymize_by_role(df: DataFrame, k: int, kinds: dict[str, str], most_suppressed: int = 0, l: int | None = None) -> tuple[DataFrame, Plan]:  # noqa: E741
    """Anonymise by what ``column_roles`` says: direct identifiers go, quasi-identifiers with a ladder in ``kinds`` are
    generalised, others of them go, the first sensitive column is held to ``l``; safe columns stay."""
    roles = {r["column"]: r["role"] for r in P.column_roles(df, df.columns).collect()}  # a row for each column
    held = {c: kind for c, kind in kinds.items() if roles.get(c) == "quasi_id"}
    if not held:
        raise ValueError("no quasi-identifier has a ladder")
    gone = [c for c, role in roles.items() if role == "direct_id" or (role == "quasi_id" and c not in held)]
    sensitive = next((c for c in df.columns if roles[c] == "sensitive"), None) if l else None
    return anonymize(df.drop(*gone), held, k, most_suppressed, None, l if sensitive else None, None, sensitive)
