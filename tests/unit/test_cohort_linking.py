"""Cohorts, linking and linked tables."""

import re

import pytest
from pyspark.sql import functions as F

from quillfold.operators import cohort as C
from quillfold.operators import linking as L
from quillfold.operators import relational as R


def crit(name, cs, **extra):
    return {"criterion": {"id": name, "concept_set": cs, **extra}}


def pheno(expression, descendants=False):
    return C.parse({"id": "p", "name": "n", "concept_sets": [{"id": "dm", "concept_ids": [201826], "include_descendants": descendants}, {"id": "drug", "concept_ids": [5]}], "expression": expression})


@pytest.fixture(scope="module")
def world(spark):
    persons = spark.createDataFrame([(i,) for i in range(1, 7)], "person_id long")
    rows = [(1, 201826, "2020-01-01", '{"negation":"affirmed"}', "Y"), (2, 443238, "2020-02-01", None, None), (3, 201826, "2020-01-01", None, "N"), (4, 5, "2020-03-01", "bad json", "Y"), (1, 5, "2020-01-20", None, "Y"), (2, 5, "2021-01-20", None, "Y"), (5, 201826, "not a date", None, "Y")]
    events = C.asserted(spark.createDataFrame(rows, "person_id long, concept_id long, event_date string, term_modifiers string, term_exists string"))
    edges = spark.createDataFrame([(201826, 443238), (443238, 9)], "ancestor_concept_id long, descendant_concept_id long")
    return persons, events, edges


def ids(df):
    return sorted(r.person_id for r in df.collect())


def test_descendants_negation_and_universe(spark, world):
    persons, events, edges = world
    assert C.descendants(edges, [201826]) == [9, 201826, 443238]
    assert ids(C.resolve(pheno(crit("a", "dm")), persons, events, edges)) == [1, 5]
    assert ids(C.resolve(pheno(crit("a", "dm"), True), persons, events, edges)) == [1, 2, 5]
    assert ids(C.resolve(pheno(crit("a", "dm", assertion={"negation": ["negated"]})), persons, events.withColumn("negation", F.when(F.col("term_present"), "affirmed").otherwise("negated")), edges)) == [3]
    assert ids(C.resolve(pheno({"operator": "not", "children": [crit("a", "dm")]}), persons, events, edges)) == [2, 3, 4, 6]


def test_anchor_and_occurrence(spark, world):
    persons, events, edges = world
    near = pheno({"operator": "and", "children": [crit("a", "dm"), crit("b", "drug", temporal={"anchor_criterion": "a", "days_before": 0, "days_after": 30})]}, True)
    assert ids(C.resolve(near, persons, events, edges)) == [1]
    assert sorted((r.criterion, r.person_id) for r in C.evidence(near, persons, events, edges).collect()) == [("a", 1), ("b", 1)]
    assert ids(C.resolve(pheno(crit("a", "drug", occurrence={"minimum": 2})), persons, events)) == []
    assert ids(C.resolve(pheno(crit("a", "drug", temporal={"start_date": "2020-02-01", "end_date": "2020-12-31"})), persons, events)) == [4]


@pytest.mark.parametrize("bad", [{"operator": "and", "children": [crit("a", "dm")]}, {"operator": "xor", "children": [crit("a", "dm"), crit("b", "dm")]}, crit("a", "nope"), crit("1a", "dm"), crit("a", "dm", occurrence={"minimum": 0}), crit("a", "dm", surprise=1), crit("a", "dm", temporal={"anchor_criterion": "a"}), {"operator": "or", "children": [crit("a", "dm"), crit("a", "dm")]}])
def test_wrong_definitions_are_refused(bad):
    with pytest.raises((ValueError, KeyError)):
        pheno(bad)


def test_identity_of_a_definition():
    assert pheno(crit("a", "dm")).digest() == pheno(crit("a", "dm")).digest() != pheno(crit("b", "dm")).digest()


def test_copy_forward_finds_the_passage(spark):
    passage = "the patient was seen in clinic today with stable vital signs and no new complaints"
    a = spark.createDataFrame([(1, f"alpha beta {passage} gamma")], "doc_id int, text string")
    b = spark.createDataFrame([(2, f"Other words. {passage.upper()}! more"), (3, "nothing shared here at all my friend of old")], "doc_id int, text string")
    (r,) = L.copy_forward(a, b).collect()
    assert (r.earlier, r.later, r.start_earlier, r.start_later, r.words) == (1, 2, 2, 2, 15)


def test_versions(spark):
    d = spark.createDataFrame([(1, "the quick brown fox jumps", "x"), (2, "the quick brown fox jumps over the dog", "x"), (3, "the quick brown fox jumps", "x"), (4, "the quick brown fox jumps", "y")], "doc_id int, text string, block string")
    p = L.similar_pairs(d, d)
    rel = {(r.a, r.b): r.relation for r in L.classify_versions(p, F.lit(True), F.col("size_b") > F.col("size_a"), F.col("shared") / F.col("size_a")).collect()}
    assert rel == {(1, 2): "amendment", (1, 3): "near_duplicate", (2, 3): "none"}


def test_version_pairs_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    long = " ".join(f"word{i * 7919 % 1009} stands{i}" for i in range(9000))  # over 100,000 characters
    own = [(1000, long), (1001, long + " and an addendum"), (1002, long[:90_000]), (1003, ""), (1004, "!"), (1005, None), (None, long), (1006, "abc"), (1007, "ABC."), (1008, "abcd")]
    docs = docs.unionByName(spark.createDataFrame(own, "doc_id long, text string"))

    def grams(text):
        t = re.sub("[^a-z0-9_]+", " ", text.lower()).strip(" ")
        return {t[i : i + 5] for i in range(max(len(t) - 4, 1))}

    sets = {r.doc_id: grams(r.text) for r in docs.collect() if r.doc_id is not None and r.text is not None}
    want = {}
    for a in sets:
        for b in sets:
            k, na, nb = len(sets[a] & sets[b]), len(sets[a]), len(sets[b])
            if a < b and (amends := nb > na and k / na >= 0.6 or None or k / (na + nb - k) >= 0.92 and "copy"):
                want[a, b] = (k, na, nb, "near_duplicate" if amends == "copy" else "amendment")
    got = L.version_pairs(docs).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.shared, r.size_a, r.size_b, r.relation) for r in got} == want
    assert want[1000, 1001][3] == "amendment" and (1003, 1004) in want and max(len(s) for s in sets.values()) > 20_000
    assert L.version_pairs(docs.limit(0)).count() == 0


def test_components_and_lineage(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "u long, v long")
    nodes = spark.createDataFrame([(i,) for i in [*range(10), 20, 21, 30]], "node long")
    assert {r.node: r.component for r in L.label_components(edges, nodes).collect()} == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20, 30: 30}
    s = spark.createDataFrame([(1, "c", 5), (2, "c", 7), (3, "d", 1)], "doc_id int, c string, t int")
    assert {r.doc_id: (r.successor, r.is_superseded) for r in L.superseded(s, "c", "t").collect()} == {1: (2, True), 2: (None, False), 3: (None, False)}


def test_linked_tables_keep_joins_and_intervals(spark):
    pat = spark.createDataFrame([("p1", "Ann", "1980-01-01"), ("p2", "Bob", "1990-02-02")], "patient_id string, name string, birth_date string")
    enc = spark.createDataFrame([("e1", "p1", "2020-01-01", "2020-01-05"), ("e2", "p2", "2020-03-01", "2020-03-02"), ("e3", "p1", "2020-06-01", "2020-06-09")], "encounter_id string, patient_id string, admission_date string, discharge_date string")
    specs = {"pat": R.TableSpec({"patient_id": "p"}, ("birth_date",), "patient_id", ("name",)), "enc": R.TableSpec({"patient_id": "p", "encounter_id": "e"}, ("admission_date", "discharge_date"), "patient_id", (), (("patient_id", "pat", "patient_id"),))}
    out = R.deidentify_tables({"pat": pat, "enc": enc}, specs, b"secret")
    joined = out["enc"].join(out["pat"], "patient_id")
    assert joined.count() == 3 and "name" not in out["pat"].columns
    stays = [r[0] for r in out["enc"].select(F.date_diff("discharge_date", "admission_date")).collect()]
    assert sorted(stays) == [1, 4, 8]
    assert {r.patient_id for r in out["pat"].collect()}.isdisjoint({"p1", "p2"})
    with pytest.raises(ValueError):
        R.deidentify_tables({"pat": pat.limit(0), "enc": enc}, specs, b"secret")
    links = spark.createDataFrame([("p1", "a"), ("p2", "b")], "subject string, surrogate string")
    assert R.subject_consistency(links, links).count() == 0
    assert R.subject_consistency(links, links.withColumn("surrogate", F.lit("z"))).count() == 2
