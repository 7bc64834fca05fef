"""Differentially private releases, their budget, and synthetic tables. Aggregates and noise run in Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import quoted


def laplace_scale(sensitivity: float, epsilon: float) -> float:
    if sensitivity <= 0 or epsilon <= 0:
        raise ValueError("sensitivity and epsilon must be positive")
    return sensitivity / epsilon


def gaussian_sd(sensitivity: float, epsilon: float, delta: float) -> float:
    if not 0 < delta < 1:
        raise ValueError("delta must lie between 0 and 1")
    return laplace_scale(sensitivity, epsilon) * math.sqrt(2 * math.log(1.25 / delta))


def laplace_noise(u: float, scale: float) -> float:
    """Noise from a uniform draw in [0, 1); 0 is moved off the pole."""
    u = u or 2.0**-53
    return -scale * math.copysign(1, u - 0.5) * math.log1p(-2 * abs(u - 0.5)) if u != 0.5 else 0.0


@dataclass
class Budget:
    """Sequential composition; a charge beyond what is left is refused and nothing is released."""

    epsilon: float
    delta: float = 0.0
    entries: list[tuple[str, float, float]] = field(default_factory=list)

    def charge(self, name: str, epsilon: float, delta: float = 0.0) -> None:
        if epsilon <= 0 or delta < 0:
            raise ValueError("a charge must be positive")
        spent = [sum(e[i] for e in self.entries) for i in (1, 2)]
        if spent[0] + epsilon > self.epsilon + 1e-12 or spent[1] + delta > self.delta + 1e-15:
            raise PermissionError("the privacy budget is spent")
        self.entries.append((name, epsilon, delta))

    def ledger(self, spark) -> DataFrame:
        return spark.createDataFrame(self.entries, "release string, epsilon double, delta double")


def bounded_aggregates(df: DataFrame, value: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """n and clamped sum, by group: what noise is added to. Nulls count in neither, NaN as the lower bound."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(float(low)))
    v = F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.sum(v).alias("total"))


def uniform(seed: int, name: str, keys: list[Column]) -> Column:
    """A number between 0 and 1, fixed by the seed, the draw's name and the group; for releases the seed is a secret."""
    held = [x for k in keys for x in (F.lit("\x1f"), F.coalesce(k.cast("string"), F.lit("")))]
    digest = F.sha2(F.concat(F.lit(f"{seed}\x1f{name}"), *held).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def laplace(u: Column, scale: float) -> Column:
    return -F.lit(scale) * F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5))


def gaussian(u: Column, v: Column, sd: float) -> Column:
    return F.lit(sd) * F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def release(aggregates: DataFrame, budget: Budget, epsilon: float, low: float, high: float, seed: int, name: str = "release", delta: float | None = None) -> DataFrame:
    """Noisy n, total and mean of bounded aggregates; a group for each row, whose number the caller must know is public.

    Laplace noise, or Gaussian with a ``delta``; half of the budget goes to either figure. Noise is drawn where the rows
    are, so any number of groups is released. A person may be in one group, once.
    """
    budget.charge(name, epsilon, delta or 0.0)
    keys = [c for c in aggregates.columns if c not in ("n", "total")]
    most = float(max(abs(low), abs(high)))

    def noise(what: str, sensitivity: float) -> Column:
        draw = lambda i: uniform(seed, f"{name}\x1f{what}{i}", [quoted(k) for k in keys])
        if delta is None:
            return laplace(draw(""), laplace_scale(sensitivity, epsilon / 2))
        return gaussian(draw(""), draw("2"), gaussian_sd(sensitivity, epsilon / 2, delta / 2))

    n, total = F.col("n") + noise("n", 1.0), F.coalesce("total", F.lit(0.0)) + noise("total", most)
    out = aggregates.select(*(quoted(k) for k in keys), n.alias("n"), total.alias("total"))
    return out.withColumn("mean", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("total") / F.greatest(F.col("n"), F.lit(1.0)))))


def utility_curve(spark, epsilons: list[float], sensitivity: float) -> DataFrame:
    """epsilon, expected absolute error, standard deviation of Laplace noise."""
    rows = [(float(e), laplace_scale(sensitivity, e), laplace_scale(sensitivity, e) * math.sqrt(2)) for e in epsilons]
    return spark.createDataFrame(rows, "epsilon double, expected_error double, sd double")


@dataclass(frozen=True)
class Synthesizer:
    """Marginals and rank correlation of a table: quantiles of numbers, shares of categories, a Gaussian copula."""

    numeric: dict[str, list[float]]
    categories: dict[str, list[tuple[str, float]]]
    cholesky: list[list[float]]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categories]


def fit_synthesizer(df: DataFrame, numeric: list[str], categorical: list[str], points: int = 101) -> Synthesizer:
    """One pass for quantiles, one for each category's counts, one for the correlation of ranks.

    Every value of a categorical column is kept, so the model on the driver grows with their number.
    """
    at = [i / (points - 1) for i in range(points)]
    q = df.agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in numeric)).first()
    numbers = {c: [float(x) for x in q[c]] for c in numeric}
    shares = {}
    for c in categorical:
        rows = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "v").collect()
        total = sum(r["n"] for r in rows)
        shares[c] = [(r["v"], r["n"] / total) for r in rows]
    # Ranks are read off the quantiles, so no global sort is needed.
    place = lambda c: sum((F.when(F.col(c) >= x, 1).otherwise(0) for x in numbers[c][1:-1]), F.lit(0)).cast("double")
    n = len(numeric)
    corr = np.eye(n + len(categorical))
    if n > 1:
        r = df.select(*(place(c).alias(f"r{i}") for i, c in enumerate(numeric))).agg(*(F.corr(f"r{i}", f"r{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(i))).first()
        for i in range(n):
            for j in range(i):
                corr[i, j] = corr[j, i] = 2 * math.sin(math.pi / 6 * (r[f"c{i}_{j}"] or 0.0))
    values, vectors = np.linalg.eigh(corr)
    corr = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    return Synthesizer(numbers, shares, np.linalg.cholesky(corr).tolist())


def sample_synthesizer(spark, model: Synthesizer, rows: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """Synthetic rows, drawn in parallel; a row depends on the seed and its number alone."""
    schema = "row_id long, " + ", ".join([f"`{c}` double" for c in model.numeric] + [f"`{c}` string" for c in model.categories])

    def draw(batches):
        import pandas as pd

        chol = np.array(model.cholesky)
        for b in batches:
            z = np.stack([np.random.default_rng((seed, int(i))).standard_normal(len(chol)) for i in b["id"]]) @ chol.T if len(b) else np.zeros((0, len(chol)))
            u = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))) if z.size else z
            out = {"row_id": b["id"]}
            for k, (c, qs) in enumerate(model.numeric.items()):
                out[c] = np.interp(u[:, k], np.linspace(0, 1, len(qs)), qs)
            for k, (c, ps) in enumerate(model.categories.items(), len(model.numeric)):
                edges = np.cumsum([p for _, p in ps])
                names = np.array([v for v, _ in ps], dtype=object)
                out[c] = names[np.minimum(np.searchsorted(edges, u[:, k], side="right"), len(ps) - 1)]
            yield pd.DataFrame(out)

    return spark.range(0, rows, 1, partitions).mapInPandas(draw, schema)


def without_source_rows(synthetic: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Synthetic rows that copy no source row."""
    s = source.select(F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256).alias("_h")).distinct()
    return synthetic.join(s, F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256) == F.col("_h"), "left_anti")
