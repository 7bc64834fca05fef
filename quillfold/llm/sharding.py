"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Each shard prefers the slots in its own order, an arithmetic sequence around the
table whose start and step come from digests of its name. Shards take turns; on its turn a shard claims the first slot of
its order that is free. So every shard gets the same number of slots, give or take one turn, and a shard that comes or
goes moves little besides its own slots. A key's slot is its digest modulo the table; the table, whose size is a
parameter and not the data's, is broadcast, so placement takes constant time and no shuffle.

Keys decide alone, so a source with a third of all rows spreads like any other. Writing deals each shard's rows in turn
to ``writers`` tasks, whatever their keys, so no task holds a whole shard, nor all rows of a key that very many bear. The
turn follows from a row's place in its input part, so a repeated task deals alike.

Defined cases: a null key counts as the empty text; equal keys share a shard; very long texts and other columns travel as
they are; an empty table gives an empty result, and a folder that reads as one; ``place`` replaces columns called slot and
shard, in any case.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import quoted, unused, work_dir

SHARDS, SLOTS = 16, 2053


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the position of its shard among the names."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not names or len(names) > slots:
        raise ValueError("there must be a shard, and no more shards than slots")
    at = [_number(f"{n}#offset") % slots for n in names]
    step = [_number(f"{n}#skip") % (slots - 1) + 1 for n in names]
    table, claimed = [-1] * slots, 0
    while claimed < slots:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            claimed += 1
            if claimed == slots:
                break
    return table


def names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def key_number(key: str | Column) -> Column:
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def place(df: DataFrame, key: str, shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The same rows with slot and shard (its position among the names)."""
    table = fill(names(shards) if isinstance(shards, int) else shards, slots)
    lookup = df.sparkSession.createDataFrame(list(enumerate(table)), "slot long, shard long")
    kept = [quoted(c) for c in df.columns if c.lower() not in ("slot", "shard")]
    rows = df.select(*kept, F.pmod(key_number(key), F.lit(slots)).alias("slot"))
    return rows.join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")


def write_shards(df: DataFrame, key: str, folder: str | None = None, shards: int | list[str] = SHARDS, slots: int = SLOTS, writers: int | None = None) -> str:
    """Write the rows below ``folder``/shard=N; each shard's rows are dealt to ``writers`` tasks.

    By default there are as many tasks as the session has shuffle partitions, or the next multiple of the shards.
    """
    folder = folder or work_dir(df.sparkSession) + "/shards"
    total = shards if isinstance(shards, int) else len(shards)
    writers = writers or max(1, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // total))
    placed = place(df, key, shards, slots)
    (turn,) = unused(placed, "_turn")
    # Rows of an input part are dealt in turn, by their number in it.
    rows = placed.withColumn(turn, F.pmod(F.monotonically_increasing_id(), F.lit(writers)))
    dealt = rows.repartition(total * writers, "shard", turn).drop(turn)
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return folder


ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard,
    CAST('0x' || substr(md5('shard-' || lpad(CAST(i AS VARCHAR), 5, '0') || '#offset'), 1, 15) AS BIGINT) % {SLOTS} AS first_slot,
    CAST('0x' || substr(md5('shard-' || lpad(CAST(i AS VARCHAR), 5, '0') || '#skip'), 1, 15) AS BIGINT) % {SLOTS - 1} + 1 AS skip
  FROM range(0, {SHARDS}) t(i)),
filled AS (
  SELECT CAST(0 AS BIGINT) AS turn, list_transform(range(0, {SLOTS}), lambda x: CAST(-1 AS BIGINT)) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(range(0, {SLOTS}), lambda x: CASE WHEN x = pick THEN turn % {SHARDS} ELSE owner[x + 1] END)
  FROM (
    SELECT turn, owner, list_filter(list_transform(range(0, {SLOTS}), lambda j: (first_slot + j * skip) % {SLOTS}), lambda s: owner[s + 1] = -1)[1] AS pick
    FROM filled JOIN shards ON shard = turn % {SHARDS} WHERE turn < {SLOTS})),
done AS (SELECT owner FROM filled WHERE turn = {SLOTS}),
placed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, owner[slot + 1] AS shard FROM placed, done
"""
