"""Disclosure control over tables: equivalence classes and what follows from them.

Every operator is one or two aggregations over the quasi-identifiers; class sizes are combined before the shuffle, so a
class of a third of all rows costs one row from each task. Null is a value of its own in a class. Reports carry counts
and digests, never cell values, unless the operator's purpose is to release rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def check_qi(df: DataFrame, qi: list[str]) -> list[str]:
    """Distinct quasi-identifiers in order; columns that are missing or not scalar are refused."""
    names = sorted(set(qi))
    if not names:
        raise ValueError("quasi-identifiers are needed")
    kinds = dict(df.dtypes)
    for n in names:
        if n not in kinds:
            raise ValueError("a quasi-identifier is not a column")
        if kinds[n].startswith(("array", "map", "struct", "variant")):
            raise ValueError("quasi-identifiers must be scalar")
    return names


def class_sizes(df: DataFrame, qi: list[str]) -> DataFrame:
    """The quasi-identifiers and ``size`` of each equivalence class."""
    return df.groupBy(*check_qi(df, qi)).agg(F.count("*").alias("size"))


def k_report(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """One row: achieved_k, classes, rows, violating_classes, violating_rows."""
    small = F.col("size") < k
    return class_sizes(df, qi).agg(
        F.min("size").alias("achieved_k"),
        F.count("*").alias("classes"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("rows"),
        F.count_if(small).alias("violating_classes"),
        F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)).alias("violating_rows"),
    )


def _join_classes(df: DataFrame, classes: DataFrame, qi: list[str], how: str) -> DataFrame:
    marked = classes.select(*(F.col(c).alias(f"_c_{c}") for c in qi), *(c for c in classes.columns if c not in qi))
    on = [df[c].eqNullSafe(marked[f"_c_{c}"]) for c in qi]
    return df.join(marked, on, how).drop(*(f"_c_{c}" for c in qi))


def violating_rows(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """The rows in classes below ``k``."""
    names = check_qi(df, qi)
    return _join_classes(df, class_sizes(df, names).where(F.col("size") < k).drop("size"), names, "left_semi")


def suppress_small_classes(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """The rows in classes of at least ``k``: the smallest suppression that reaches k-anonymity."""
    names = check_qi(df, qi)
    return _join_classes(df, class_sizes(df, names).where(F.col("size") >= k).drop("size"), names, "left_semi")


def suppression_proposal(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """One row: rows, suppressed_rows, feasible (not when the whole table would go)."""
    r = k_report(df, qi, k)
    return r.select("rows", F.col("violating_rows").alias("suppressed_rows"), (F.col("violating_rows") < F.col("rows")).alias("feasible"))


def apply_suppression(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """``suppress_small_classes``, refusing to release an empty table."""
    if not suppression_proposal(df, qi, k).first()["feasible"]:
        raise ValueError("suppression would remove every row")
    return suppress_small_classes(df, qi, k)


def l_diversity(df: DataFrame, qi: list[str], sensitive: str) -> DataFrame:
    """For each class: size, distinct_l, entropy (bits) of the sensitive values."""
    names = check_qi(df, qi)
    counts = df.groupBy(*names, F.col(sensitive).alias("_s")).agg(F.count("*").alias("_n"))
    # entropy = log2(size) - sum(n log2 n) / size needs no second pass over the class
    return counts.groupBy(*names).agg(
        F.sum("_n").alias("size"),
        F.count("*").alias("distinct_l"),
        (F.log2(F.sum("_n").cast("double")) - F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))) / F.sum("_n")).alias("entropy"),
    )


def l_report(df: DataFrame, qi: list[str], sensitive: str, l: int) -> DataFrame:  # noqa: E741
    """One row: achieved_distinct, achieved_entropy, violating classes by either rule."""
    classes = l_diversity(df, qi, sensitive)
    bits = F.log2(F.lit(float(l)))
    return classes.agg(F.min("distinct_l").alias("achieved_distinct"), F.min("entropy").alias("achieved_entropy"), F.count_if(F.col("distinct_l") < l).alias("distinct_violations"), F.count_if(F.col("entropy") < bits - TOLERANCE).alias("entropy_violations"))


def t_closeness(df: DataFrame, qi: list[str], sensitive: str) -> DataFrame:
    """For each class: size and t, the total variation between its sensitive values and the table's.

    Values that a class lacks count by their share of the table, so no class by value grid is built.
    """
    names = check_qi(df, qi)
    counts = df.groupBy(*names, F.col(sensitive).alias("_s")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    overall = counts.groupBy("_s").agg(F.sum("_n").alias("_all")).withColumnRenamed("_s", "_g")
    sizes = counts.groupBy(*names).agg(F.sum("_n").alias("size"))
    rows = counts.join(overall, counts["_s"].eqNullSafe(overall["_g"])).crossJoin(F.broadcast(total))  # one row
    rows = _join_classes(rows, sizes, names, "inner")
    p, q = F.col("_n") / F.col("size"), F.col("_all") / F.col("_total")
    return rows.groupBy(*names).agg(F.first("size").alias("size"), (0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))).alias("t"))


def t_report(df: DataFrame, qi: list[str], sensitive: str, t: float) -> DataFrame:
    return t_closeness(df, qi, sensitive).agg(F.max("t").alias("achieved_t"), F.count_if(F.col("t") > t + TOLERANCE).alias("violations"))


def reid_risk(sample: DataFrame, population: DataFrame, qi: list[str]) -> DataFrame:
    """For each sample class: sample_size, population_size, prosecutor (1/f) and journalist (1/F) risk.

    A population class that is smaller than the sample's is no model of it: the journalist risk is then 1.
    """
    names = check_qi(sample, qi)
    f = sample.groupBy(*names).agg(F.count("*").alias("sample_size"))
    big = population.groupBy(*names).agg(F.count("*").alias("population_size"))
    rows = _join_classes(f, big, names, "left").withColumn("population_size", F.coalesce("population_size", F.lit(0)))
    journalist = F.when(F.col("population_size") < F.col("sample_size"), F.lit(1.0)).otherwise(1 / F.col("population_size").cast("double"))
    return rows.select(*names, "sample_size", "population_size", (1 / F.col("sample_size").cast("double")).alias("prosecutor"), journalist.alias("journalist"))


def reid_report(sample: DataFrame, population: DataFrame, qi: list[str]) -> DataFrame:
    """One row: maximal and expected prosecutor risk, maximal journalist risk, and the record-weighted marketer risk."""
    r = reid_risk(sample, population, qi)
    n = F.sum("sample_size")
    return r.agg(n.alias("records"), F.max("prosecutor").alias("prosecutor_max"), (F.count("*") / n).alias("prosecutor_mean"), F.max("journalist").alias("journalist_max"), (F.sum(F.col("journalist") * F.col("sample_size")) / n).alias("marketer"))


def population_frequencies(sample: DataFrame, reference: DataFrame, qi: list[str]) -> DataFrame:
    """One row: k_map (least population frequency), greatest and mean linkage risk, delta_presence bounds."""
    r = reid_risk(sample, reference, qi)
    share = F.col("sample_size") / F.when(F.col("population_size") > 0, F.col("population_size"))
    link = 1 / F.when(F.col("population_size") > 0, F.col("population_size")).cast("double")
    n = F.sum("sample_size")
    return r.agg(F.min("population_size").alias("k_map"), F.max(link).alias("max_linkage"), (F.sum(link * F.col("sample_size")) / n).alias("mean_linkage"), F.min(share).alias("delta_min"), F.max(share).alias("delta_max"))


def membership_probe(release: DataFrame, candidates: DataFrame, qi: list[str]) -> DataFrame:
    """One row: release rows whose key occurs among the candidates once (unique), more often (ambiguous), never (none)."""
    names = check_qi(release, qi)
    known = candidates.groupBy(*names).agg(F.count("*").alias("_hits"))
    mine = release.groupBy(*names).agg(F.count("*").alias("_rows"))
    rows = _join_classes(mine, known, names, "left")
    add = lambda rule, name: F.coalesce(F.sum(F.when(rule, F.col("_rows"))), F.lit(0)).alias(name)
    hits = F.coalesce("_hits", F.lit(0))
    return rows.agg(add(hits == 1, "unique_rows"), add(hits > 1, "ambiguous_rows"), add(hits == 0, "unmatched_rows")).withColumn("rate", F.col("unique_rows") / F.nullif(F.col("unique_rows") + F.col("ambiguous_rows") + F.col("unmatched_rows"), F.lit(0)))


def linkage_attack(release: DataFrame, external: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Rows of the release whose whole key belongs to exactly one external identity, with it; keys with a null never match."""
    names = check_qi(release, keys)
    full = external.dropna(subset=names).groupBy(*names).agg(F.count("*").alias("_n"), F.min(identity).alias("linked_identity")).where("_n = 1").drop("_n")
    return release.join(full, names)


def leave_one_out(df: DataFrame, qi: list[str]) -> DataFrame:
    """Which quasi-identifier singles rows out: rows unique by all, and by all but each, in one pass of grouping sets.

    Columns: left_out (null for none), classes, unique_rows, contribution (share of the unique rows that are no longer so).
    """
    names = check_qi(df, qi)
    sets = [names, *([n for n in names if n != out] for out in names)]
    ids = [sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in s) for s in sets]
    grouped = df.groupingSets([[F.col(n) for n in s] for s in sets], *(F.col(n) for n in names)).agg(F.count("*").alias("size"), F.grouping_id().alias("gid"))
    per_set = grouped.groupBy("gid").agg(F.count("*").alias("classes"), F.sum(F.when(F.col("size") == 1, 1).otherwise(0)).alias("unique_rows"))
    label = F.lit(None).cast("string")
    for gid, out in zip(ids[1:], names):
        label = F.when(F.col("gid") == gid, F.lit(out)).otherwise(label)
    base = per_set.where("gid = 0").select(F.col("unique_rows").alias("_base"))
    out = per_set.crossJoin(F.broadcast(base))  # one row
    return out.select(label.alias("left_out"), "classes", "unique_rows", F.coalesce((F.col("_base") - F.col("unique_rows")) / F.nullif(F.col("_base"), F.lit(0)), F.lit(0.0)).alias("contribution"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows, nulls, distinct_values, distinctness, date_ratio, numeric_ratio, mean_length; one pass."""
    text = {c: F.col(c).cast("string") for c in columns}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        t = text[c]
        aggs += [
            F.count_if(t.isNull()).alias(f"nulls_{i}"),
            F.count_distinct(t).alias(f"distinct_{i}"),
            F.count_if(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias(f"dates_{i}"),
            F.count_if(t.try_cast("double").isNotNull()).alias(f"numbers_{i}"),
            F.sum(F.length(t)).alias(f"chars_{i}"),
        ]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{k}_{i}").alias(k) for k in ("nulls", "distinct", "dates", "numbers", "chars"))) for i, c in enumerate(columns))))
    long = wide.select("rows", rows.alias("r")).select("r.column", "rows", "r.nulls", "r.distinct", "r.dates", "r.numbers", "r.chars")
    filled = F.nullif(F.col("rows") - F.col("nulls"), F.lit(0))
    return long.select("column", "rows", "nulls", F.col("distinct").alias("distinct_values"), (F.col("distinct") / filled).alias("distinctness"), (F.col("dates") / filled).alias("date_ratio"), (F.col("numbers") / filled).alias("numeric_ratio"), (F.col("chars") / filled).alias("mean_length"))


#: Parts of column names that name a person outright, describe one, or are sensitive.
DIRECT_NAMES = ("name", "ssn", "mrn", "email", "phone", "address", "passport", "account")
QUASI_NAMES = ("age", "zip", "postal", "birth", "sex", "gender", "race", "city", "region", "date", "nation")
SENSITIVE_NAMES = ("diagnosis", "disease", "result", "salary", "income", "balance", "note", "text")


def column_roles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_stats`` with a role: direct_id, sensitive, quasi_id or safe, by name first, then by shape."""
    s = column_stats(df, columns)
    has = lambda words: F.lower("column").rlike("|".join(words))
    role = (
        F.when(has(DIRECT_NAMES), "direct_id")
        .when(has(SENSITIVE_NAMES) | ((F.col("mean_length") >= 20) & (F.col("distinctness") >= 0.8)), "sensitive")
        .when(has(QUASI_NAMES) | (F.col("date_ratio") >= 0.8), "quasi_id")
        .when(F.col("distinctness") >= 0.8, "quasi_id")
        .otherwise("safe")
    )
    return s.withColumn("role", role)


def direct_identifiers_removed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table without the columns whose names name a person."""
    gone = columns if columns is not None else [c for c in df.columns if any(w in c.lower() for w in DIRECT_NAMES)]
    return df.drop(*gone)


def joint_class_sizes(df: DataFrame, person: str, qi: list[str]) -> DataFrame:
    """k by person over several rows: a person's class is the multiset of all their rows' quasi-identifiers."""
    names = check_qi(df, qi)
    profile = df.groupBy(person).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("profile"))
    key = F.sha2(F.to_json("profile").cast("binary"), 256)
    return profile.groupBy(key.alias("profile_sha256")).agg(F.count("*").alias("persons"))


def information_loss(levels: dict[str, int], heights: dict[str, int]) -> float:
    """Mean share of each ladder climbed."""
    return sum(levels[c] / max(1, heights[c]) for c in levels) / max(1, len(levels))


def subsets(names: list[str], most: int) -> list[tuple[str, ...]]:
    """All non-empty subsets of at most ``most`` names, small first; for profiles over few columns."""
    return [s for n in range(1, most + 1) for s in combinations(sorted(names), n)]


def row_risk(df: DataFrame, qi: list[str]) -> DataFrame:
    """Each row with class_size: by a join with the classes, so that a class of many rows stays spread."""
    names = check_qi(df, qi)
    return _join_classes(df, class_sizes(df, names).withColumnRenamed("size", "class_size"), names, "inner")


def ranked(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
