"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). Its set is its shingles of
``shingle`` words. A document that holds the window holds all of them, so by the prefix principle one shingle is enough
to look for, and the rarest is the cheapest:

1. Count, over all documents, the shingles that occur in the benchmark: this orders each window's shingles by rarity. A
   window with a shingle of count zero occurs nowhere and goes.
2. Join documents on the rarest shingle of each window. Its place gives the window's place; length and positional bounds
   drop places that stick out of the document; the words there are compared with the window's, exactly.
3. Merge each document's hits: words inside any occurrence, and the items they came from.

Document shingles are generated, hashed and probed within one stage; only hits are shuffled. The benchmark's shingles are
broadcast where their number is within ``BROADCAST_ROWS``, joined by a shuffle beyond.

Held in one row at most: a document's occurrences and items, and a key's windows, which its benchmark bounds; an
occurrence carries its window, and items are looked up once for each document.

Defined cases: null and empty texts have no words; very long texts are handled whole; items without words have no windows; rows that share a doc_id are
told apart by their text, and equal rows have equal results; empty tables give empty or all-clean results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import quoted, spool, unused

BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column | str) -> Column:
    """Words of a text: A-Z lowered, runs of a-z, 0-9 and characters from U+0080."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its number of rows allows it; else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, gram (the words, a space between), words, n: each window of each item once."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))))
    cut = items.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s") + 1, window).alias("words"))
    return cut.withColumn("gram", F.array_join("words", " ")).select("item", "gram", "words", F.size("words").alias("n")).dropDuplicates(["item", "gram"])


def _keys(words: str, widths: list[int]) -> Column:
    """Rows (pos, shingles from there) of a word array, one for each position."""
    longest = max(widths)
    return F.posexplode(F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words) - k, F.lit(0))) for k in range(longest)))).alias("pos", "at")


def _hash(longest: int, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.col(f"at.{k}") for k in range(width)))


def hits_by_document(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, n_hit, spans (start, end of each occurrence, in words), items (sorted): documents with hits only."""
    windows = spool(benchmark_windows(benchmark, item_col, item_text_col, window))
    grams = spool(windows.select("gram", "words", "n").dropDuplicates(["gram"]))
    # At most ``shingle`` distinct widths: shorter ones only where the benchmark has windows so short.
    widths = sorted(r["k"] for r in grams.select(F.least("n", F.lit(shingle)).alias("k")).distinct().collect()) or [shingle]
    longest = max(widths)
    width = F.least("n", F.lit(shingle))
    offsets = F.sequence(F.lit(0), F.col("n") - width)
    at = grams.select("gram", "n", "words", width.alias("k"), F.explode(offsets).alias("off"))
    at = at.withColumn("at", F.struct(*(F.get("words", F.col("off") + k).alias(str(k)) for k in range(longest))))
    key = F.lit(None).cast("long")
    for k in widths:
        key = F.when(F.col("k") == k, _hash(longest, k)).otherwise(key)
    at = spool(at.select("gram", "n", "off", key.alias("key")))

    split = _split(docs, id_col, text_col)
    rows = split.select("doc_id", "text_key", "w", _keys("w", widths))
    if len(widths) == 1:
        probes = rows.withColumn("key", _hash(longest, longest))
    else:
        probes = rows.withColumn("key", F.explode(F.array(*(_hash(longest, k) for k in widths))))

    wanted = at.select("key").distinct()
    counts = probes.select("key").join(_small(wanted), "key").groupBy("key").agg(F.count("*").alias("seen"))
    counts = spool(counts)
    rarest = at.join(counts, "key", "left").groupBy("gram").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "key", "off", "n")).alias("p")).where("p.seen > 0")
    prefix = rarest.groupBy("p.key").agg(F.collect_list(F.struct("p.off", "p.n", "gram")).alias("found"))
    prefix = spool(prefix)

    few = prefix.count() <= BROADCAST_ROWS
    # Within one stage a row may refer to its whole document; before a shuffle it takes along only the words around it.
    low = F.lit(0) if few else F.greatest(F.col("pos") - window, F.lit(0))
    near = F.col("w") if few else F.slice("w", low + 1, 2 * window + 1)
    placed = probes.select("doc_id", "text_key", "pos", "key", F.size("w").alias("n_words"), low.alias("low"), near.alias("near"))
    start = lambda x: F.col("pos") - x["off"]
    there = lambda x: F.array_join(F.slice("near", F.greatest(start(x) - F.col("low") + 1, F.lit(1)), x["n"]), " ")
    holds = lambda x: (start(x) >= 0) & (start(x) + x["n"] <= F.col("n_words")) & (there(x) == x["gram"])
    # Empty findings go after an outer explosion: a filter before it would become part of the join and break its generated code.
    hit = placed.join(F.broadcast(prefix) if few else prefix, "key").select("doc_id", "text_key", F.transform(F.filter("found", holds), lambda x: F.struct(start(x).alias("start"), (start(x) + x["n"]).alias("end"), x["gram"].alias("gram"))).alias("found"))
    # An occurrence is a row; a window's items are looked up once for each document in which it occurs.
    places = hit.select("doc_id", "text_key", F.explode_outer("found").alias("x")).where("x IS NOT NULL").select("doc_id", "text_key", "x.*")
    places = spool(places.distinct())
    per_doc = places.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("start", "end")))).alias("spans"))
    met = places.select("doc_id", "text_key", "gram").distinct().join(_small(windows.select("gram", "item")), "gram")
    named = met.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # A word is hit once: a stretch counts from the end of what is already covered.
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(F.greatest(acc["to"], x["end"]).alias("to"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["to"], x["start"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    both = per_doc.alias("p").join(named.alias("i"), F.col("p.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("p.text_key") == F.col("i.text_key")))
    return both.select("p.doc_id", "p.text_key", "spans", covered.alias("n_hit"), "items")


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text_key(F.col("text")).alias("text_key"), words_of("text").alias("w"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, spans, items: a row for each document. Options are those of ``hits_by_document``."""
    per_doc = hits_by_document(docs, benchmark, id_col, text_col, **options)
    sized = _split(docs, id_col, text_col).select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    both = sized.alias("d").join(per_doc.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left")
    return both.select("d.doc_id", "d.text_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, all columns whatever their names, in which no window occurs."""
    hit_id, hit_key = unused(docs, "_hit_id", "_hit_key")
    hit = spool(hits_by_document(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)))
    return docs.join(_small(hit), quoted(id_col).eqNullSafe(F.col(hit_id)) & (text_key(quoted(text_col)) == F.col(hit_key)), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s + 1, s + 10), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN grams g ON p.gram = g.gram AND p.n = g.n),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""
