"""Mentions to concepts: exact and normalised matches, trigram cosine, vector neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import prepare, spool

#: Queries that every task holds at once.
QUERY_BLOCK = 8192
EXACT, NORMALIZED, ABBREVIATION = 1.0, 0.95, 0.90


def normal(c: Column | str) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]+", " "))


def lexical_match(mentions: DataFrame, aliases: DataFrame, abbreviations: DataFrame | None = None) -> DataFrame:
    """mention_id, code, score, tier: the best alias of each mention; ties go to the lesser code.

    ``mentions`` is (mention_id, surface), ``aliases`` (alias, code), ``abbreviations`` (short, alias).
    """
    a = aliases.select("alias", "code", normal("alias").alias("n"))
    exact = mentions.join(a, F.col("surface") == F.col("alias")).select("mention_id", "code", F.lit(EXACT).alias("score"), F.lit("exact").alias("tier"))
    folded = mentions.withColumn("n", normal("surface")).join(a, "n").select("mention_id", "code", F.lit(NORMALIZED).alias("score"), F.lit("normalized").alias("tier"))
    rows = exact.unionByName(folded)
    if abbreviations is not None:
        long = abbreviations.select(F.upper("short").alias("s"), normal("alias").alias("n")).join(a, "n").select("s", "code")
        rows = rows.unionByName(mentions.join(long, F.upper("surface") == F.col("s")).select("mention_id", "code", F.lit(ABBREVIATION).alias("score"), F.lit("abbreviation").alias("tier")))
    order = Window.partitionBy("mention_id").orderBy(F.col("score").desc(), "code")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def trigrams(c: Column | str) -> Column:
    t = F.concat(F.lit("  "), normal(c), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(t) - 2), lambda i: F.substring(t, i, 3))


def sparse_match(mentions: DataFrame, aliases: DataFrame, k: int = 3) -> DataFrame:
    """mention_id, alias, sim, rank: the ``k`` aliases with the highest trigram TF-IDF cosine.

    idf = ln((1 + N) / (1 + df)) + 1 over the aliases; a mention's trigrams that no alias has weigh by df = 0.
    """
    grams = lambda df, key, text: df.select(F.col(key).alias("key"), F.explode(trigrams(text)).alias("g")).groupBy("key", "g").agg(F.count("*").alias("tf"))
    a, q = grams(aliases.select("alias").distinct(), "alias", "alias"), grams(mentions, "mention_id", "surface")
    n = aliases.select("alias").distinct().agg(F.count("*").alias("N"))
    df = a.groupBy("g").agg(F.count("*").alias("df"))
    weigh = lambda x: x.join(df, "g", "left").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.coalesce("df", F.lit(0)))) + 1))
    aw, qw = weigh(a), weigh(q)
    norm = lambda x, name: x.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    dots = qw.select(F.col("key").alias("mention_id"), "g", F.col("w").alias("wq")).join(aw.select(F.col("key").alias("alias"), "g", F.col("w").alias("wa")), "g").groupBy("mention_id", "alias").agg(F.sum(F.col("wq") * F.col("wa")).alias("dot"))
    out = dots.join(norm(qw, "nq").withColumnRenamed("key", "mention_id"), "mention_id").join(norm(aw, "na").withColumnRenamed("key", "alias"), "alias")
    out = out.select("mention_id", "alias", F.round(F.col("dot") / (F.col("nq") * F.col("na")), 6).alias("sim"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.col("sim").desc(), "alias"))).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, sim, rank: nearest vectors of a stated set of queries, against all vectors but their own.

    Queries are dealt into blocks that every task can hold; each block is one scan of the vectors, in which a task keeps
    its best ``k`` of each query, and the tasks' bests are merged. Ties go to the lesser id. Vectors that are null, of zero
    length, or of another dimension than a query's have no similarity to it.
    """
    spark = prepare(vectors.sparkSession)
    asked = spool(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0"))
    blocks = max(1, -(-asked.count() // block))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # a block of stated size
        held = spark.sparkContext.broadcast([(r["vec_id"], np.array([np.nan if x is None else x for x in r["embedding"]], dtype=np.float64)) for r in part])

        def run(batches, held=held):
            import pyarrow as pa
            import pyarrow.compute as pc

            by_size: dict[int, tuple] = {}
            for n in {len(e) for _, e in held.value}:
                ids, m = zip(*((q, e) for q, e in held.value if len(e) == n))
                m = np.stack(m)
                by_size[n] = (np.array(ids), m, np.linalg.norm(m, axis=1), [np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)])
            for batch in batches:
                sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                for n, (ids, m, norm, best) in by_size.items():
                    at = np.flatnonzero(sizes == n)
                    for lo in range(0, len(at), 2048):
                        some = batch.take(pa.array(at[lo : lo + 2048]))
                        own = some.column(0).to_numpy()
                        v = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                        with np.errstate(all="ignore"):
                            sim = np.round(m @ v.T / (norm[:, None] * np.linalg.norm(v, axis=1)[None, :]), 6)
                        sim[(ids[:, None] == own[None, :]) | ~np.isfinite(sim)] = -np.inf
                        sim = np.concatenate([best[0], sim], axis=1)
                        which = np.concatenate([best[1], np.broadcast_to(own, (len(ids), len(own)))], axis=1)
                        first = np.lexsort((which, -sim), axis=1)[:, :k]
                        best[0], best[1] = np.take_along_axis(sim, first, 1), np.take_along_axis(which, first, 1)
            for ids, _, _, (sim, which) in by_size.values():
                q, c = np.nonzero(np.isfinite(sim))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(which[q, c], pa.int64()), pa.array(sim[q, c], pa.float64())], names=["query_id", "vec_id", "sim"])

        one = rows.mapInArrow(run, "query_id long, vec_id long, sim double")
        out = one if out is None else out.unionByName(one)
    best = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "vec_id")  # over k rows from each task
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """label, dim, mean: the mean vector of each label, long."""
    return vectors.select(label, F.posexplode("embedding").alias("dim", "x")).groupBy(label, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
