"""Redaction within the row, hot keys, cascades and releases, against values worked out apart from the code."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfold import scratch
from quillfold.functions import clinical as K
from quillfold.functions import validators as V
from quillfold.operators import cohort, dp, graph, grounding, linking, metrics, policy
from quillfold.operators import spans as S


def test_rows_without_an_id_or_with_a_shared_one_are_redacted(spark):
    docs = spark.createDataFrame([(None, "mail bob@x.example now", 7, "k"), (1, "zzzz a@b.example zzzz", 8, "l"), (1, "zzzz zzzz zzzz zzzz", 9, "m"), (2, None, 0, "n")], "doc_id long, text string, _id int, _Spans string")
    got = {r._id: (r.redacted, r.n_spans, r._Spans) for r in S.deidentify(docs, ["EMAIL"]).collect()}
    assert got == {7: ("mail [EMAIL] now", 1, "k"), 8: ("zzzz [EMAIL] zzzz", 1, "l"), 9: ("zzzz zzzz zzzz zzzz", 0, "m"), 0: (None, 0, "n")}
    found = S.apply_policy(S.detect(docs, ["EMAIL"]))
    assert {r._id: (r.redacted, r.n_spans) for r in S.redact(docs, found).collect()} == {k: v[:2] for k, v in got.items()}
    plan = S.deidentify(docs, ["EMAIL", "CARD"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_every_probe_holds_wherever_its_pattern_matches(spark):
    rng, marks = random.Random(3), "0123456789-.: ()@aFMRN/htps"
    samples = ["212-555-2100", "(212) 555-2100", "123-45-6789", "10.20.30.40", "4111111111111111", "https://a.b/c", "a@b.cd", "2024-01-31", "00:1B:44:11:3A:B7", "MRN: 1234567", "12345-6789"]
    texts = [rng.choice(samples) + "".join(rng.choice(marks) for _ in range(6)) for _ in range(300)] + ["".join(rng.choice(marks) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for label in S.PATTERNS:
        lost = df.where(F.col("t").rlike(S.PATTERNS[label]) & ~S.may_hold(F.col("t"), label))
        assert lost.count() == 0, label


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@x.example" for i in range(3000))
    r = S.deidentify(spark.createDataFrame([(text,)], "text string"), ["EMAIL"]).first()
    assert r.n_spans == 3000 and r.redacted == " ".join(["[EMAIL]"] * 3000)


def test_surrogates_are_of_their_kind(spark):
    text = "a@b.example a@b.example 212-555-2100 (312) 555-2199 4111111111111111 123-45-6789 10.1.2.3 2020-02-30 2020-03-01"
    docs = spark.createDataFrame([("s", text), ("s", text), ("t", text), (None, text)], "subject string, text string")
    labels = ["EMAIL", "PHONE", "CARD", "SSN", "IPV4", "DATE"]
    rows = S.deidentify(docs, labels, method="replace", secret=b"k", subject_col="subject").collect()
    words = [r.redacted.split(" ") for r in rows]
    assert words[0] == words[1] != words[2] and words[0][0] == words[0][1] and not set(words[0][:8]) & set(text.split(" ")[:8])
    parts = re.fullmatch(r"(\S+@example\.org) \1 (\d{3}-555-01\d\d) (\(\d{3}\) 555-01\d\d) (4000\d{12}) (9\d\d-\d\d-\d{4}) (198\.\d+\.\d+\.\d+) \S+ \S+", rows[0].redacted)
    assert parts and spark.createDataFrame([(parts[4],)], "c string").select(V.card("c")).first()[0]
    shifted = S.deidentify(docs, ["DATE"], secret=b"k", subject_col="subject", max_days=10).collect()
    assert [r.redacted.split(" ")[-2] for r in shifted] == ["[DATE]"] * 4 and shifted[3].redacted.endswith("[DATE]")
    days = {(F_date(r.redacted.split(" ")[-1]) - F_date("2020-03-01")).days for r in shifted[:2]}
    assert len(days) == 1 and 0 < abs(days.pop()) <= 10
    assert S.deidentify(docs, ["DATE"]).first().redacted.endswith("[DATE] [DATE]")  # without a key, dates are masked, not released
    with pytest.raises(ValueError):
        S.deidentify(docs, method="melt")


def F_date(text):
    import datetime

    return datetime.date.fromisoformat(text)


def test_bounded_aggregates_leave_nulls_out(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (None,), (99.0,), (-5.0,), (float("nan"),)], "v double")
    r = dp.bounded_aggregates(rows, "v", 0, 50).first()
    assert (r.n, r.total) == (4, 51.0)


def test_cascade_sends_on_what_the_cheap_stage_left_open(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    seen = {1: 0.9, 2: 0.3}
    spans = lambda rows, how: spark.createDataFrame([(d, 0, 1, "X", s, how) for d, s in rows], "doc_id long, start int, end int, label string, score double, detector string")
    cheap = lambda df: spans([(r.doc_id, seen[r.doc_id]) for r in df.collect() if r.doc_id in seen], "cheap")
    dear = lambda df: spans([(r.doc_id, 1.0) for r in df.collect()], "dear")
    got = {(r.doc_id, r.stage) for r in policy.cascade(docs, cheap, dear, 0.5).collect()}
    assert got == {(1, "cheap"), (2, "cheap"), (2, "dear"), (3, "dear"), (None, "dear")}


def test_descendants_have_no_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(90)] + [(90, 0)], "ancestor_concept_id long, descendant_concept_id long")
    assert cohort.descendants(edges, [0]) == list(range(91))


def test_components_of_a_long_chain_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(scratch.spread_join, "__defaults__", (20, 0))
    edges = [(i, i + 1) for i in range(400)] + [(5000, 6000 + i) for i in range(300)] + [(None, 3), (9, 9)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(401), 0), 5000: 5000, **dict.fromkeys(range(6000, 6300), 5000)}
    words = graph.components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")).collect()
    assert {r.node: r.root for r in words} == {"a": "a", "b": "a", "c": "a"}


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(0, i) for i in range(200)] + [(i, i) for i in range(1, 50)] + [(None, 1)], "k long, x long")
    side = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    want = sorted(rows.join(side, "k").select("k", "x", "m").collect())
    for options in ({"hot": 10, "small": 0}, {"hot": 10}):
        assert sorted(scratch.spread_join(rows, side, "k", "n", 249, **options).select("k", "x", "m").collect()) == want


def test_transient_spools_go_but_for_those_kept(spark):
    with scratch.transient() as held:
        a = scratch.spool(spark.range(3))
        b = held.keep(scratch.spool(spark.range(4)))
    assert b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(*a.inputFiles()).count()


def test_near_copies_and_amendments_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 70").select("doc_id", "text")
    long = " ".join(f"word{i * 7919 % 1009} stands{i}" for i in range(2000))
    own = [(1000, long), (1001, long + " x"), (1002, long + " y"), (1003, ""), (1004, "!"), (1005, None), (None, long), (1006, "abc"), (1007, "ABC."), (1008, long[:20_000])]
    docs = docs.unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    texts = {r.doc_id: re.sub("[^a-z0-9_]+", " ", r.text.lower()).strip(" ") for r in docs.collect() if r.doc_id is not None and r.text is not None}
    heads = {}
    for i in sorted(texts):
        heads.setdefault(texts[i], i)
    sets = {i: {t[k : k + 5] for k in range(max(len(t) - 4, 1))} for t, i in heads.items()}
    near, amends, amended = (dict.fromkeys(sets, 0) for _ in range(3))
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k / len(sets[a] | sets[b]) >= 0.92:
                near[a] += 1
                near[b] += 1
            if a < b and len(sets[b]) > len(sets[a]) and k / len(sets[a]) >= 0.6:
                amends[b] += 1
                amended[a] += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in linking.near_copies(docs).collect()}
    assert got == {i: (heads[t], near[heads[t]]) for i, t in texts.items()} and near[1001] == 2
    got = {r.doc_id: (r.class_id, r.n_amends, r.n_amended) for r in linking.amendment_counts(docs).collect()}
    assert got == {i: (heads[t], amends[heads[t]], amended[heads[t]]) for i, t in texts.items()} and amended[1000] == 2
    assert linking.near_copies(docs.limit(0)).count() == 0


def _shuffled(spark, run) -> int:
    """Bytes of shuffle that a run writes."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def _unlike(spark, n: int):
    """Texts of like size that have little in common, and their bytes."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.randrange(16**7):07x}" for _ in range(250))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), sum(len(t) for _, t in rows)


def test_near_copies_move_each_text_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 8)
    docs, size = _unlike(spark, 400)
    assert _shuffled(spark, lambda: linking.near_copies(docs).collect()) < 5 * size


def test_amendments_move_each_text_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 16)
    docs, size = _unlike(spark, 400)
    assert _shuffled(spark, lambda: linking.amendment_counts(docs).collect()) < 3 * size


def test_version_pairs_move_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 16)
    docs, size = _unlike(spark, 400)
    assert _shuffled(spark, lambda: linking.version_pairs(docs).collect()) < 2 * size


def test_sets_at_the_bound_share_a_key_and_are_paired():
    rng, starts = np.random.default_rng(3), linking.band_starts()
    for duplicate in (0.92, 0.8, 1.0):
        for a in [*range(1, 60), *rng.integers(60, 1500, 60)]:
            b = int(rng.integers(int(np.ceil(duplicate * a)), a + 1))
            shared = int(np.ceil(duplicate * (a + b) / (1 + duplicate) - 1e-9))
            if shared <= b and shared / (a + b - shared) >= duplicate:
                pool = rng.permutation(np.unique(rng.integers(0, 1 << 40, 2 * a + 50, dtype=np.uint64)))
                x, y = (linking.part_keys(np.sort(s), duplicate, starts) for s in (pool[:a], np.append(pool[:shared], pool[a : a + b - shared])))
                assert len(np.intersect1d(x, y)), (duplicate, a, b)
    keys = np.array([2] * 3 + [4] * 20 + [7] * 20 + [9], dtype=np.uint64)
    ids = np.array([*range(3), *range(100, 120), *range(200, 220), 300])
    u, v, sure = linking.group_pairs(keys, ids)
    got = set(zip(u.tolist(), v.tolist(), sure.tolist()))
    assert got == {(0, 1, False), (0, 2, False), (1, 2, False)} | {(100, i, True) for i in range(101, 120)} | {(i, j, False) for i in range(200, 220) for j in range(i + 1, 220)}


def test_one_cluster_or_family_over_many_parts(spark):
    rng = random.Random(1)
    rows = [(i, "c" if i % 3 else f"d{i % 7}", rng.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, c string, t long").repartition(7)
    want = {}
    for c in {r[1] for r in rows}:
        members = [r[0] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))]
        want |= dict(zip(members, [*members[1:], None]))
    assert {r.doc_id: r.successor for r in linking.superseded(df, "c", "t").collect()} == want
    ps = [(f"k{i}", rng.choice(["g", "h"]), rng.choice([0.001 * rng.randrange(1, 900), 0.01])) for i in range(400)] + [("none", "g", None)]
    want = {"none": None}
    for g in "gh":
        own = sorted((p, k) for k, x, p in ps if x == g and p is not None)
        least = 1.0
        for r in range(len(own), 0, -1):
            least = min(least, own[r - 1][0] * len(own) / r)
            want[own[r - 1][1]] = least
    got = {r.k: r.adjusted for r in metrics.benjamini_hochberg(spark.createDataFrame(ps, "k string, g string, p double"), "k", "p", ["g"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)


def test_dense_neighbours_over_blocks_of_queries(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(80)] + [(90, None), (91, [0.0] * 6), (92, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    stored = {r.vec_id: r.embedding for r in v.collect()}
    got = {(r.query_id, r.rank): r.vec_id for r in grounding.dense_top_k(v.where("vec_id % 9 = 0"), v, 3, block=4).collect()}
    for q in range(0, 80, 9):
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        best = sorted((-round(cos(stored[q], stored[i]), 6), i) for i in range(80) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [i for _, i in best]


def test_negation_scopes_and_modifiers(spark):
    text = "No fever or chills. Denies pain but has a cough; rash was ruled out, edema not present. Cannot be excluded: asthma. Naïve noé. Fever today."
    r = spark.createDataFrame([(text,)], "t string").select(F.array(*(K.is_negated("t", F.lit(x)) for x in ("fever", "chills", "pain", "cough", "rash", "edema", "asthma", "absentia"))).alias("x"), K.negation_scopes("t").alias("s")).first()
    assert r.x == [False, False, True, False, True, True, False, False]
    for s in r.s:
        assert text[s.cue_start : s.cue_end].lower() in (*K.FORWARD_CUES, *K.BACKWARD_CUES) and 0 <= s.start <= s.end <= len(text)
    pairs = spark.createDataFrame([("a: 1\nnot a field\nTwo words = x: y\n: z",), (None,), ("",)], "t string").select(K.key_values("t").alias("k")).collect()
    assert [tuple(x) for x in pairs[0].k] == [(0, "a", "1"), (2, "two words", "x: y")] and not pairs[1].k and not pairs[2].k
    sig = spark.createDataFrame([("max 3 days therefor 2 days",)], "t string").select(K.sig("t").alias("s")).first().s
    assert sig.duration_days is None


def test_links_are_added_up_for_many_sets_at_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    draw = lambda n, low, high: [np.unique(rng.integers(low, high, rng.integers(1, 500))).astype(np.uint32) for _ in range(n)]
    left, right, far = draw(150, 0, 400), draw(300, 0, 400), draw(150, 390, 800)
    ids = rng.permutation(1000)
    words = []
    count = linking.bit_counts
    monkeypatch.setattr(linking, "bit_counts", lambda rows, planes: words.append(rows.size) or count(rows, planes))
    large = linking._Bits(linking._Sets.from_bytes(linking._Sets.of(ids[150:450], right).to_bytes()))
    for cells in (1 << 18, 3000, 200):
        monkeypatch.setattr(linking, "CELLS", cells)
        for sets in (left, far):
            words.clear()
            small = linking._Sets.of(ids[:150], sets)
            got = {}
            for found in linking._links(small, large, 0.6):
                i, j, shared = linking._pairs(small, large, found)
                got |= {(int(small.ids[a]), int(large.ids.ravel()[b])): int(n) for a, b, n in zip(i, j, shared)}
            want = {}
            for a, s in zip(ids[:150].tolist(), sets):
                for b, t in zip(ids[150:450].tolist(), right):
                    if b > a and len(t) > len(s) and (k := len(np.intersect1d(s, t))) / len(s) >= 0.6:
                        want[a, b] = k
            assert got == want and (sets is far or len(want) > 1000)
            assert sum(words) * 64 < sum(map(len, sets)) * len(right) * (2 if sets is left else 0.2)


def test_links_of_many_blocks_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linking, "TILE", 32)
    monkeypatch.setattr(linking, "BLOCKS_HELD", 2)
    rng = random.Random(7)
    words = [["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)] for letters in ("abcde", "vwxyz")]
    texts = [" ".join(rng.choices(words[k % 2], k=rng.choice((1, 3, 40, 300)))) for k in range(150)]
    texts += [texts[5] + " \u0130\u212a.", texts[5] + "  i k", None, "", "!", texts[7].upper(), texts[9][:-1] + "\u00e9", "\u00e9"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {r.doc_id: r.t for r in docs.select("doc_id", linking.normalized("text").alias("t")).collect() if r.t is not None}
    sets = {i: {t[k : k + 5] for k in range(max(len(t) - 4, 1))} for i, t in held.items()}
    want, counts = {}, {}
    heads = {t: min(i for i in held if held[i] == t) for t in held.values()}
    for a in sets:
        for b in sets:
            k, na, nb = len(sets[a] & sets[b]), len(sets[a]), len(sets[b])
            amends = a < b and nb > na and k / na >= 0.6
            if a < b and (amends or k / (na + nb - k) >= 0.92):
                want[a, b] = (k, na, nb, "amendment" if amends else "near_duplicate")
            if amends and heads[held[a]] == a and heads[held[b]] == b:
                for i, at in ((b, 0), (a, 1)):
                    counts.setdefault(i, [0, 0])[at] += 1
    got = linking.version_pairs(docs).collect()
    assert len(got) == len(want) > 500 and {(r.a, r.b): (r.shared, r.size_a, r.size_b, r.relation) for r in got} == want
    got = {r.doc_id: (r.class_id, r.n_amends, r.n_amended) for r in linking.amendment_counts(docs).collect()}
    assert got == {i: (heads[t], *counts.get(heads[t], (0, 0))) for i, t in held.items()}
