"""The shared work folder, spools that cut lineage, joins on keys that may be hot, and what Python workers need.

A spool is a Parquet table below ``spark.checkpoint.dir``, which driver and executors share, so that a lost executor
costs a re-read and not a wrong or repeated computation. Where the setting is absent, a folder of this machine is used if
all tasks run in the driver's own process, and nothing otherwise.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])
_OWN: list[str] = []
_HELD: list["Held"] = []

#: Rows in an Arrow batch: texts are large, and a batch is held whole on both sides.
BATCH_ROWS = 1024
#: Keys that ``spread_join`` sends to every task, at most; each then has more than a ``HOT_KEYS / 2``-th of all rows.
HOT_KEYS = 10_000
#: Rows of a side that every task may hold, whatever its keys.
SMALL_SIDE = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it, and bound their batches and threads."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")
    return spark


def work_dir(spark: SparkSession) -> str:
    """A new folder's URI below the folder that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="quillfold-"))
            atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/quillfold/{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The table written to that path, read again."""
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held:
    """The spools made within a ``transient`` block."""

    def __init__(self) -> None:
        self.spools: list[tuple[str, DataFrame]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Let this spool outlive the block."""
        self.spools = [(path, t) for path, t in self.spools if t is not df]
        return df


@contextlib.contextmanager
def transient() -> Iterator[Held]:
    """Spools made in the block are deleted at its end, but for those kept; blocks may lie within others."""
    held = Held()
    _HELD.append(held)
    try:
        yield held
    finally:
        _HELD.remove(held)
        for path, df in held.spools:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spool(df: DataFrame, **options: str) -> DataFrame:
    """The table written to the shared folder, read again."""
    path = work_dir(df.sparkSession)
    out = write(df, f"{path}/t", **options)
    if _HELD:
        _HELD[-1].spools.append((path, out))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete spools that nothing will read again."""
    for df in tables:
        for f in {os.path.dirname(f) for f in df.inputFiles()}:
            _delete(df.sparkSession, f)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that the table does not have, whatever their case."""
    held, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread_join(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int, hot: int = HOT_KEYS, small: int = SMALL_SIDE) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key and, as ``weight``, how many of ``rows`` bear it.

    A side of at most ``small`` rows is broadcast. Of a larger one, keys that bear more than 2 * total / hot rows, at most hot / 2 of them, meet their rows where those lie, by a
    broadcast of that size at most; all others by a shuffle in which no key outweighs the rest.
    """
    if side.count() <= small:
        return rows.join(F.broadcast(side), key)
    most = max(1, 2 * total // hot)
    heavy, light = side.where(F.col(weight) > most), side.where(F.col(weight) <= most)
    there = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return there.unionByName(rest)
