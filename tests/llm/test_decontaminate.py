import hashlib
import re

from quillfold.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[s : s + window]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if g := grams.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= g
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_agrees_with_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert any(r[-1] for r in want)
    assert rows(dc.digest(dc.find_contamination(docs, items))) == want


def test_edge_rows(spark, monkeypatch):
    base = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu"
    items = [(1, base), (2, "Lone"), (3, "two words"), (4, None), (5, "!!"), (6, base.upper() + " nu"), (10, "a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, "lone LONE x"), (4, "x " + base + " y " + base), (5, "two, words"), (5, "two other words"), (None, "Two-Words"), (7, "a " * 5000), (8, "Ünï " + base), (9, base[:40]), (4, "x " + base + " y " + base)]
    d = spark.createDataFrame([(*r, 5, "k") for r in docs], "doc_id long, text string, n_hit int, key string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, gram int")
    want = brute(docs, items)
    assert rows(dc.digest(dc.find_contamination(d, b))) == want
    monkeypatch.setattr(dc, "BROADCAST_ROWS", -1)
    assert rows(dc.digest(dc.find_contamination(d, b))) == want
    assert rows(dc.digest(dc.find_contamination(d, b.limit(0)))) == brute(docs, [])
    assert rows(dc.digest(dc.find_contamination(d.limit(0), b))) == []


def test_no_python_in_the_plan(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = dc.find_contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
