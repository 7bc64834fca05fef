"""Disclosure control against golden facts and brute force."""

import math
from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfold.functions import generalize as G
from quillfold.operators import dp as D
from quillfold.operators import lattice as T
from quillfold.operators import privacy as P


def test_k_anonymity_basic(spark):
    df = spark.createDataFrame([(30, "1000", "a"), (30, "1000", "b"), (41, "2000", "c")], "age int, zip string, disease string")
    r = P.k_report(df, ["age", "zip"], 2).first()
    assert (r.achieved_k, r.classes, r.rows, r.violating_classes, r.violating_rows) == (1, 2, 3, 1, 1)
    assert sorted(x["size"] for x in P.class_sizes(df, ["zip", "age", "age"]).collect()) == [1, 2]
    assert P.apply_suppression(df, ["age"], 2).count() == 2
    with pytest.raises(ValueError):
        P.apply_suppression(df, ["age"], 5)


def test_null_and_empty_are_classes_of_their_own(spark):
    df = spark.createDataFrame([(None,), ("",), ("unknown",), ("30",)], "age string")
    assert P.class_sizes(df, ["age"]).count() == 4
    assert P.suppress_small_classes(df.union(df.limit(1)), ["age"], 2).count() == 2


def test_quasi_identifiers_are_checked(spark):
    df = spark.createDataFrame([([1], 2)], "a array<int>, b int")
    for qi in (["a"], ["c"], []):
        with pytest.raises(ValueError):
            P.class_sizes(df, qi)


def test_l_and_t_reference(spark):
    rows = [("a", d) for d in ("x", "x", "x", "y")] + [("b", d) for d in ("x", "x", "y", "z")]
    df = spark.createDataFrame(rows, "grp string, diagnosis string")
    l = {r.grp: (r.distinct_l, r.entropy) for r in P.l_diversity(df, ["grp"], "diagnosis").collect()}  # noqa: E741
    assert l["a"][0] == 2 and l["b"][0] == 3
    assert l["a"][1] == pytest.approx(0.8112781244591328) and l["b"][1] == pytest.approx(1.5)
    skew = spark.createDataFrame([("A", "flu"), ("A", "flu"), ("B", "cold"), ("B", "cold")], "g string, disease string")
    assert [r.t for r in P.t_closeness(skew, ["g"], "disease").collect()] == [0.5, 0.5]
    assert P.t_report(skew, ["g"], "disease", 0.4).first().violations == 2


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from([None, "u", "v", "w"])), min_size=1, max_size=25))
def test_t_closeness_agrees_with_the_grid(spark, rows):
    got = {r.g: r.t for r in P.t_closeness(spark.createDataFrame(rows, "g string, s string"), ["g"], "s").collect()}
    whole = Counter(s for _, s in rows)
    for g in {g for g, _ in rows}:
        own = Counter(s for h, s in rows if h == g)
        want = 0.5 * sum(abs(own[s] / sum(own.values()) - whole[s] / len(rows)) for s in whole)
        assert got[g] == pytest.approx(want)


def test_reid_and_population(spark):
    sizes = lambda ns: [(f"r{i}", i) for i, n in enumerate(ns) for _ in range(n)]
    s, p = (spark.createDataFrame(sizes(n), "region string, band int") for n in ((1, 2, 3), (2, 4, 6)))
    r = P.reid_report(s, p, ["region", "band"]).first()
    assert r.prosecutor_max == 1.0 and r.prosecutor_mean == pytest.approx(3 / 6) and r.journalist_max == 0.5
    assert P.reid_report(p, s, ["region", "band"]).first().journalist_max == 1.0
    k = P.population_frequencies(s, p, ["region", "band"]).first()
    assert k.k_map == 2 and k.max_linkage == 0.5


def test_membership_and_linkage(spark):
    r = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "x string, y int")
    c = spark.createDataFrame([("a", 1, "p"), ("b", 1, "q"), ("b", 1, "r"), ("c", None, "s")], "x string, y int, who string")
    m = P.membership_probe(r, c, ["x", "y"]).first()
    assert (m.unique_rows, m.ambiguous_rows, m.unmatched_rows) == (2, 1, 0)
    assert [(z.x, z.linked_identity) for z in P.linkage_attack(r, c, ["x", "y"], "who").collect()] == [("a", "p")]


def test_leave_one_out_finds_the_singling_column(spark):
    df = spark.createDataFrame([(30, "x", f"2020-01-0{i}") for i in range(1, 7)], "age int, city string, visit string")
    got = {r.left_out: (r.unique_rows, r.contribution) for r in P.leave_one_out(df, ["age", "city", "visit"]).collect()}
    assert got[None] == (6, 0.0) and got["visit"] == (0, 1.0) and got["age"] == (6, 0.0)


def test_order_does_not_matter(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    one, two = (sorted(map(tuple, P.class_sizes(x, ["a", "b"]).collect())) for x in (df.repartition(7), df.orderBy(F.desc("id")).coalesce(1)))
    assert one == two


def test_ladders(spark):
    one = spark.createDataFrame([(34, "02139", "2020-05-17")], "age int, zip string, day string")
    got = one.select(*(G.generalize_value("age", "age", i).alias(f"a{i}") for i in range(5)), *(G.generalize_value("zip", "zip", i).alias(f"z{i}") for i in range(8)), *(G.generalize_value("date", "day", i).alias(f"d{i}") for i in range(4))).first()
    assert list(got) == ["34", "30-34", "30-39", "20-39", "*", "02139", "0213", "021", "02", "0", "*", "*", "*", "2020-05-17", "2020-05", "2020", "*"]
    bands = spark.createDataFrame([(89,), (90,), (150,), (0,)], "a int").select(G.age_band("a", 20)).collect()
    assert [r[0] for r in bands] == ["80-89", "90+", "90+", "0-19"]
    with pytest.raises(Exception, match="between 0 and 150"):
        spark.createDataFrame([(151,)], "a int").select(G.age_band("a", 5)).collect()
    with pytest.raises(ValueError):
        G.generalize_value("age", "age", 5)


def test_lattice_agrees_with_every_node(spark):
    rows = [((i * 7) % 90, f"{(i * 13) % 30:03d}") for i in range(120)]
    df = spark.createDataFrame(rows, "age int, zip string")
    kinds = {"age": "age", "zip": "zip"}
    age = lambda a, l: [str(a), *(f"{a // w * w}-{min(a // w * w + w - 1, 89)}" for w in (5, 10, 20)), "*"][l]  # noqa: E731, E741
    code = lambda z, l: (z[: len(z) - l] or "*") if l < 7 else "*"  # noqa: E731, E741
    for k, limit in ((5, 0), (8, 10)):
        best = None
        for a, z in product(range(5), range(8)):
            n = Counter((age(x, a), code(y, z)) for x, y in rows)
            lost = sum(v for v in n.values() if v < k)
            if lost <= limit and lost < len(rows):
                loss = (a / 4 + z / 7) / 2 + lost / len(rows)
                best = min(best or (9,), (loss, (a, z), lost))
        plan = T.search(df, kinds, k, limit)
        assert plan.loss == pytest.approx(best[0])
        released, again = T.anonymize(df, kinds, k, limit)
        assert again == plan and released.count() == len(rows) - plan.suppressed
        assert P.k_report(released, ["age", "zip"], k).first().achieved_k >= k


def test_lattice_refuses_the_impossible(spark):
    with pytest.raises(ValueError):
        T.search(spark.createDataFrame([(1,)], "age int"), {"age": "age"}, 2)


def test_lattice_with_t(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("c", 1)], "grp string, s int")
    assert T.search(df, {"grp": "other"}, 1, 0, t=0.35, sensitive="s").levels == {"grp": 1}


def test_noise_and_budget(spark):
    assert D.laplace_scale(1, 0.5) == 2 and D.gaussian_sd(1, 1, 1e-5) == pytest.approx(math.sqrt(2 * math.log(1.25e5)))
    assert D.laplace_noise(0.0, 1) < -30 and D.laplace_noise(0.75, 1) == pytest.approx(math.log(2))
    b = D.Budget(1.0)
    b.charge("a", 0.6)
    with pytest.raises(PermissionError):
        b.charge("b", 0.5)
    assert [e[0] for e in b.entries] == ["a"]
    df = spark.createDataFrame([("x", float(i)) for i in range(200)], "g string, v double")
    out = D.release(D.bounded_aggregates(df, "v", 0, 50, ["g"]), D.Budget(5.0), 5.0, 0, 50, seed=1).first()
    assert abs(out.n - 200) < 10 and 0 <= out["mean"] <= 50


def test_synthetic_rows(spark):
    df = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"), ((F.col("id") % 100) * 2).cast("double").alias("y"), F.when(F.col("id") % 4 == 0, "p").otherwise("q").alias("c"))
    m = D.fit_synthesizer(df, ["x", "y"], ["c"])
    s = D.sample_synthesizer(spark, m, 1000, seed=5)
    r = s.agg(F.corr("x", "y").alias("r"), F.avg((F.col("c") == "q").cast("double")).alias("q"), F.avg("x").alias("x")).first()
    assert r.r > 0.9 and abs(r.q - 0.75) < 0.06 and abs(r.x - 49.5) < 5
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, D.sample_synthesizer(spark, m, 1000, seed=5, partitions=3).collect()))


def test_synthesizer_keeps_rare_categories(spark):
    df = spark.range(3000).selectExpr("cast(id as double) AS x", "cast(CASE WHEN id < 1500 THEN 0 ELSE id END as string) AS c")
    (shares,) = D.fit_synthesizer(df, ["x"], ["c"]).categories.values()
    assert len(shares) == 1501 and shares[0] == ("0", 0.5) and abs(sum(p for _, p in shares) - 1) < 1e-9
