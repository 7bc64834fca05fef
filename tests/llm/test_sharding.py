import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from quillfold.llm import sharding


def preference(name, slots):
    n = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    offset, skip = n(name + "#offset") % slots, n(name + "#skip") % (slots - 1) + 1
    return [(offset + j * skip) % slots for j in range(slots)]


def brute(names, slots):
    orders, table, turn = [preference(n, slots) for n in names], {}, 0
    while len(table) < slots:
        i = turn % len(names)
        table[next(s for s in orders[i] if s not in table)] = i
        turn += 1
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize(("shards", "slots"), [(1, 7), (3, 13), (7, 101), (13, 13)])
def test_fill_agrees_with_taking_turns(shards, slots):
    names = sharding.names(shards)
    table = sharding.fill(names, slots)
    assert table == brute(names, slots)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    names = sharding.names(16)
    before, after = sharding.fill(names, 2053), sharding.fill(names[:5] + names[6:], 2053)
    kept = [names[i] for i in before]
    now = [(names[:5] + names[6:])[i] for i in after]
    assert sum(a != b for a, b in zip(kept, now) if a != names[5]) < 0.25 * 2053


@pytest.mark.parametrize(("names", "slots"), [(["a"], 8), ([], 7), (["a", "b", "c"], 2)])
def test_wrong_tables_are_refused(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_placement_and_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' AS shard")
    folder = sharding.write_shards(docs, "doc_id", shards=4, slots=101)
    table = brute(sharding.names(4), 101)
    rows = spark.read.parquet(folder).collect()
    assert len(rows) == docs.count()
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, table[slot])


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 3)], "k string, slot int")
    rows = sharding.place(df, "k").collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.k == "a"}) == 1 and len({r.slot for r in rows if not r.k}) == 1
    assert sharding.place(df.limit(0), "k").count() == 0


def test_a_key_that_most_rows_bear_is_dealt_to_all_writers(spark, tmp_path):
    from quillfold.llm import sharding

    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, None).otherwise(F.col("id")).alias("doc_id"), F.col("id").alias("x"), F.lit("s").alias("Slot"), F.lit("t").alias("_turn")).repartition(4)
    folder = sharding.write_shards(rows, "doc_id", str(tmp_path / "out"), writers=4)
    back = spark.read.parquet(folder)
    assert sorted(r.x for r in back.collect()) == list(range(4000)) and back.select("_turn").distinct().count() == 1
    files = back.where("doc_id IS NULL").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(r["count"] for r in files) < 3600 / 2
    empty = sharding.place(rows.limit(0), "doc_id")
    assert empty.count() == 0
