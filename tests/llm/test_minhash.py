import random

import numpy as np

from quillfold.llm import minhash as mh
from quillfold.llm.graph import components


def brute(rows, words, percent=80):
    """Least doc_id of each document's component, over all pairs of full shingle sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets.setdefault(i, set()).update(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_agrees_with_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(mh.near_duplicates(docs.repartition(3), words=2)) == brute(rows, 2)


def test_a_large_diverse_group(spark, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(60)}" for _ in range(150)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(rng.randrange(0, 30)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(mh.near_duplicates(docs, words=2)) == brute(rows, 2)


def test_edge_rows(spark):
    long = " ".join(f"v{i % 9000}" for i in range(40_000))
    rows = [(5, "One"), (9, "oNE "), (1, None), (2, ""), (3, " \t\n"), (7, long), (4, long + " tail"), (8, "É x"), (6, "é x")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, component_id int, key string")
    out = got(mh.near_duplicates(docs, words=2))
    assert out == brute(rows, 2) and out[9][1] == 5 and out[7][1] == 4 and out[1] == (0, 1) and out[8][1] == 8
    assert mh.near_duplicates(docs.limit(0)).count() == 0
    twice = mh.near_duplicates(docs.union(docs), words=2)
    assert twice.count() == 18 and got(twice) == out
    none = mh.near_duplicates(spark.createDataFrame([(None, "a b c"), (3, "a b c")], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in none.collect()) == [(False, 3, True), (True, None, True)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    c = rng.integers(0, 2**63, 100).astype(np.uint64)
    x, y = (mh.signature(np.concatenate([a, z])) for z in (b, c))
    assert abs((x == y).mean() - 900 / 1100) < 0.1


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    out = components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.node: r.root for r in out.collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_that_share_an_id_lose_no_link(spark):
    x = " ".join(f"a{i}" for i in range(40))
    y = " ".join(f"b{i}" for i in range(40))
    rows = [(0, x), (1, x), (1, y), (2, y + " tail"), (3, "quite another text of its own"), (3, "and one more under that id"), (3, "and one more under that id")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _Gone int").repartition(3)
    out = mh.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(0, 0), (1, 0), (2, 0), (3, 3)} and len(out) == 7
    kept = mh.without_duplicates(docs).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(0, x), (3, rows[5][1]), (3, rows[4][1])] or sorted((r.doc_id, r.text) for r in kept) == sorted({rows[0], rows[4], rows[5]})
    again = mh.without_duplicates(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept)) and docs.columns == mh.without_duplicates(docs).columns


def test_ids_may_be_strings(spark):
    text = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([("z", text), ("doc-9", text + " b"), ("q", "alone in the world of five"), (None, text)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in mh.near_duplicates(docs).collect()} == {("z", "doc-9"), ("doc-9", "doc-9"), ("q", "q"), (None, None)}


def test_recall_on_the_larger_table(spark):
    """Every link of all pairs is found: the components are equal."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(mh.near_duplicates(docs, words=2)) == brute(rows, 2)


def test_bands_are_shuffled_once(spark, sf, monkeypatch):
    """Bucket members come from one scan without an exchange, whatever the table's size; copies beyond the limit lose no link."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, plans = got(mh.near_duplicates(docs, words=2)), []

    def watched(rows, side, key, *a, f=mh.spread_join, **b):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return f(rows, side, key, *a, **b)

    monkeypatch.setattr(mh, "spread_join", watched)
    assert got(mh.near_duplicates(docs, words=2)) == want
    assert "hashpartitioning" not in plans[0] and "Aggregate" not in plans[0]
    monkeypatch.setattr(mh, "BROADCAST_ROWS", 0)
    assert got(mh.near_duplicates(docs, words=2)) == want
