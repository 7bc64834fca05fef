"""Queries of the disclosure-control operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import generalize as G
from ..functions import hashing as H
from ..operators import privacy as P
from .registry import query, table

QI = ["c_nationkey", "c_mktsegment"]


@query("SELECT c_nationkey, c_mktsegment, count(*) AS size FROM customer GROUP BY ALL")
def kanon_classes(spark, sf):
    return P.class_sizes(table(spark, sf, "customer"), QI)


@query("""WITH c AS (SELECT count(*) AS size FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT min(size) AS achieved_k, count(*) AS classes, CAST(sum(size) AS BIGINT) AS rows, count(*) FILTER (size < 12) AS violating_classes, CAST(coalesce(sum(size) FILTER (size < 12), 0) AS BIGINT) AS violating_rows FROM c""")
def kanon_report(spark, sf):
    return P.k_report(table(spark, sf, "customer"), QI, 12)


@query("SELECT c_custkey FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n < 12")
def kanon_violations(spark, sf):
    return P.violating_rows(table(spark, sf, "customer"), QI, 12).select("c_custkey")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n >= 12")
def kanon_suppress(spark, sf):
    return P.suppress_small_classes(table(spark, sf, "customer"), QI, 12).select("c_custkey", *QI)


@query("""WITH c AS (SELECT count(*) AS size FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT CAST(sum(size) AS BIGINT) AS rows, CAST(coalesce(sum(size) FILTER (size < 12), 0) AS BIGINT) AS suppressed_rows, coalesce(sum(size) FILTER (size < 12), 0) < sum(size) AS feasible FROM c""")
def suppression_proposal(spark, sf):
    return P.suppression_proposal(table(spark, sf, "customer"), QI, 12)


_L = """WITH n AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS size FROM n)"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))


@query(_L + " SELECT o_orderstatus, o_orderpriority, CAST(max(size) AS BIGINT) AS size, count(*) AS distinct_l FROM c GROUP BY ALL")
def ldiversity_distinct(spark, sf):
    return P.l_diversity(_orders(spark, sf), ["o_orderstatus", "o_orderpriority"], "y").drop("entropy")


@query(_L + " SELECT o_orderstatus, o_orderpriority, round(-sum((n / size) * log2(n / size)) + 0, 6) AS entropy FROM c GROUP BY ALL")
def ldiversity_entropy(spark, sf):
    return P.l_diversity(_orders(spark, sf), ["o_orderstatus", "o_orderpriority"], "y").select("o_orderstatus", "o_orderpriority", F.round(F.col("entropy") + 0, 6).alias("entropy"))


@query(_L + """, g AS (SELECT y, sum(n) / (SELECT sum(n) FROM n) AS q FROM n GROUP BY y),
k AS (SELECT DISTINCT o_orderstatus, o_orderpriority FROM n)
SELECT k.o_orderstatus, k.o_orderpriority, round(0.5 * sum(abs(coalesce(c.n / c.size, 0) - g.q)), 6) AS t
FROM k CROSS JOIN g LEFT JOIN c ON c.o_orderstatus = k.o_orderstatus AND c.o_orderpriority = k.o_orderpriority AND c.y = g.y GROUP BY ALL""")
def tcloseness_tv(spark, sf):
    return P.t_closeness(_orders(spark, sf), ["o_orderstatus", "o_orderpriority"], "y").select("o_orderstatus", "o_orderpriority", F.round("t", 6).alias("t"))


_R = """WITH s AS (SELECT c_nationkey, c_mktsegment, count(*) AS f FROM customer WHERE c_custkey % 10 = 0 GROUP BY ALL),
p AS (SELECT c_nationkey, c_mktsegment, count(*) AS g FROM customer GROUP BY ALL),
r AS (SELECT s.*, coalesce(g, 0) AS g FROM s LEFT JOIN p USING (c_nationkey, c_mktsegment)),
j AS (SELECT *, 1.0::DOUBLE / f AS pros, CASE WHEN g < f THEN 1.0 ELSE 1.0::DOUBLE / g END AS jour FROM r)"""


def _sample(spark, sf):
    c = table(spark, sf, "customer")
    return c.where("c_custkey % 10 = 0"), c


@query(_R + " SELECT c_nationkey, c_mktsegment, f AS sample_size, g AS population_size, round(pros, 6) AS prosecutor, round(jour, 6) AS journalist FROM j")
def reid_classes(spark, sf):
    return P.reid_risk(*_sample(spark, sf), QI).select(*QI, "sample_size", "population_size", F.round("prosecutor", 6).alias("prosecutor"), F.round("journalist", 6).alias("journalist"))


@query(_R + " SELECT CAST(sum(f) AS BIGINT) AS records, round(max(pros), 6) AS prosecutor_max, round(count(*) / sum(f), 6) AS prosecutor_mean, round(max(jour), 6) AS journalist_max, round(sum(jour * f) / sum(f), 6) AS marketer FROM j")
def reid_report(spark, sf):
    r = P.reid_report(*_sample(spark, sf), QI)
    return r.select("records", *(F.round(c, 6).alias(c) for c in r.columns[1:]))


@query(_R + " SELECT min(g) AS k_map, round(max(1.0::DOUBLE / g), 6) AS max_linkage, round(sum(1.0::DOUBLE / g * f) / sum(f), 6) AS mean_linkage, round(min(f / g), 6) AS delta_min, round(max(f / g), 6) AS delta_max FROM r")
def kmap_delta_presence(spark, sf):
    r = P.population_frequencies(*_sample(spark, sf), QI)
    return r.select("k_map", *(F.round(c, 6).alias(c) for c in r.columns[1:]))


_BANDS = "SELECT {0} AS id, {1} AS nation, CAST(floor({2} / 500) AS BIGINT) AS band FROM {3}"


def _banded(spark, sf, t, key, nation, balance):
    return table(spark, sf, t).select(F.col(key).alias("id"), F.col(nation).alias("nation"), F.floor(F.col(balance) / 500).alias("band"))


_SUP, _CUS = _BANDS.format("s_suppkey", "s_nationkey", "s_acctbal", "supplier"), _BANDS.format("c_custkey", "c_nationkey", "c_acctbal", "customer")


@query(f"""WITH r AS ({_SUP}), c AS (SELECT nation, band, count(*) AS hits FROM ({_CUS}) GROUP BY ALL),
j AS (SELECT coalesce(hits, 0) AS hits FROM r LEFT JOIN c USING (nation, band))
SELECT count(*) FILTER (hits = 1) AS unique_rows, count(*) FILTER (hits > 1) AS ambiguous_rows, count(*) FILTER (hits = 0) AS unmatched_rows, round(count(*) FILTER (hits = 1) / count(*), 6) AS rate FROM j""")
def membership_probe(spark, sf):
    r = P.membership_probe(_banded(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), _banded(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal"), ["nation", "band"])
    return r.withColumn("rate", F.round("rate", 6))


@query(f"""SELECT r.id, r.nation, r.band, c.linked_identity FROM ({_SUP}) r JOIN (SELECT nation, band, min(id) AS linked_identity FROM ({_CUS}) GROUP BY ALL HAVING count(*) = 1) c USING (nation, band)""")
def linkage_attack(spark, sf):
    return P.linkage_attack(_banded(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), _banded(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal"), ["nation", "band"], "id")


@query("""WITH t AS (SELECT c_nationkey AS a, c_mktsegment AS b, CAST(floor(c_acctbal / 1000) AS BIGINT) AS c FROM customer),
g AS (SELECT NULL AS left_out, count(*) AS n FROM t GROUP BY a, b, c UNION ALL SELECT 'a', count(*) FROM t GROUP BY b, c UNION ALL SELECT 'b', count(*) FROM t GROUP BY a, c UNION ALL SELECT 'c', count(*) FROM t GROUP BY a, b),
u AS (SELECT left_out, count(*) AS classes, count(*) FILTER (n = 1) AS unique_rows FROM g GROUP BY left_out),
z AS (SELECT unique_rows AS base FROM u WHERE left_out IS NULL)
SELECT left_out, classes, unique_rows, round(CASE WHEN base = 0 THEN 0 ELSE (base - unique_rows) / base END, 6) AS contribution FROM u, z""")
def qi_profile_leave_one_out(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b"), F.floor(F.col("c_acctbal") / 1000).alias("c"))
    return P.leave_one_out(t, ["a", "b", "c"]).withColumn("contribution", F.round("contribution", 6))


_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (t IS NULL) AS nulls, count(DISTINCT t) AS distinct_values, round(count(DISTINCT t) / count(t), 6) AS distinctness, round(count(*) FILTER (regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) / count(t), 6) AS date_ratio, round(count(try_cast(t AS DOUBLE)) / count(t), 6) AS numeric_ratio, round(sum(length(t)) / count(t), 6) AS mean_length FROM (SELECT CAST({c} AS VARCHAR) AS t FROM documents)"
    for c in _COLS
)


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


@query(_STATS)
def column_role_stats(spark, sf):
    return _rounded(P.column_stats(table(spark, sf, "documents"), _COLS))


@query(f"""SELECT "column", CASE WHEN regexp_matches(lower("column"), 'name|ssn|mrn|email|phone|address|passport|account') THEN 'direct_id'
WHEN regexp_matches(lower("column"), 'diagnosis|disease|result|salary|income|balance|note|text') OR (mean_length >= 20 AND distinctness >= 0.8) THEN 'sensitive'
WHEN regexp_matches(lower("column"), 'age|zip|postal|birth|sex|gender|race|city|region|date|nation') OR date_ratio >= 0.8 THEN 'quasi_id'
WHEN distinctness >= 0.8 THEN 'quasi_id' ELSE 'safe' END AS role FROM ({_STATS})""")
def column_roles(spark, sf):
    return P.column_roles(table(spark, sf, "documents"), _COLS).select("column", "role")


@query("SELECT p_partkey, CASE WHEN p_size >= 90 THEN '90+' ELSE (p_size // 10 * 10)::VARCHAR || '-' || least(p_size // 10 * 10 + 9, 89)::VARCHAR END AS band FROM part")
def generalize_age_band(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.age_band("p_size", 10).alias("band"))


@query("SELECT c_custkey, left(lpad(c_custkey::VARCHAR, 5, '0'), 3) AS prefix, '*' AS gone FROM customer")
def generalize_prefix(spark, sf):
    z = F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    return table(spark, sf, "customer").select("c_custkey", G.zip_prefix(z, 2).alias("prefix"), G.zip_prefix(z, 5).alias("gone"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders")
def generalize_month(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", G.date_month("o_orderdate").alias("month"), G.date_year("o_orderdate").alias("year"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE '*' END AS up FROM nation")
def generalize_hierarchy(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", G.from_hierarchy(F.col("n_regionkey").cast("string"), {"0": ["south"], "1": ["west"]}, 1).alias("up"))


@query("""WITH t AS (SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band FROM customer)
SELECT c_custkey, c_nationkey, band FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, band) AS n FROM t) WHERE n >= 4""")
def stream_kanon_release(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("band"))
    return P.suppress_small_classes(t, ["c_nationkey", "band"], 4)


@query("""WITH p AS (SELECT o_custkey, sha256(string_agg(o_orderstatus || '|' || o_orderpriority, ';' ORDER BY o_orderstatus, o_orderpriority)) AS profile FROM orders GROUP BY o_custkey)
SELECT n AS persons_per_profile, count(*) AS profiles FROM (SELECT profile, count(*) AS n FROM p GROUP BY profile) GROUP BY n""")
def longitudinal_profiles(spark, sf):
    p = P.joint_class_sizes(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])
    return p.groupBy(F.col("persons").alias("persons_per_profile")).agg(F.count("*").alias("profiles"))


def _hex(n: int, digest: str) -> str:
    out = "0"
    for k in range(8):
        out = f"(({out}) * {(1 << 32) % n} + ('0x' || substr({digest}, {8 * k + 1}, 8))::BIGINT) % {n}"
    return out


@query(f"SELECT doc_id, CAST({_hex(64, 'd')} AS INTEGER) AS shard FROM (SELECT doc_id, sha256('docs:' || doc_id::VARCHAR) AS d FROM documents)")
def shard_assign(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.shard_of("doc_id", 64).alias("shard"))


@query(f"""SELECT shard, count(*) AS n, sha256(concat_ws(':', count(*), bit_xor(('0x' || substr(d, 1, 15))::BIGINT), bit_xor(('0x' || substr(d, 16, 15))::BIGINT), sum(('0x' || substr(d, 31, 8))::BIGINT)::BIGINT)) AS fingerprint
FROM (SELECT doc_id, d, CAST({_hex(16, 'd')} AS INTEGER) AS shard FROM (SELECT doc_id, sha256('docs:' || doc_id::VARCHAR) AS d FROM documents)) GROUP BY shard""")
def shard_fingerprint(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", H.shard_of("doc_id", 16).alias("shard"), H.record_digest("doc_id").alias("d"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"), H.set_fingerprint("d").alias("fingerprint"))


@query("SELECT o_orderkey, (('0x' || substr(d, 1, 8))::BIGINT & 2147483647) * 4294967296 + ('0x' || substr(d, 9, 8))::BIGINT AS key FROM (SELECT o_orderkey, sha256('orders' || chr(31) || o_orderkey::VARCHAR) AS d FROM orders)")
def surrogate_key(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", H.surrogate_key(F.lit("orders"), "o_orderkey").alias("key"))


@query("SELECT event_id, sha256('2:v1' || chr(0) || strlen(event_type)::VARCHAR || ':' || event_type || chr(0) || strlen(event_id::VARCHAR)::VARCHAR || ':' || event_id::VARCHAR || chr(0)) AS key FROM events")
def stream_dedupe_key(spark, sf):
    return table(spark, sf, "events").select("event_id", H.dedupe_key(F.lit("v1"), "event_type", "event_id").alias("key"))


_KEY = b"an example key"
_IN, _OUT = ("".join(f"{b ^ pad:02x}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
_HMAC = f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({{0}}))))"


@query(f"SELECT c_custkey, 'hmac-sha256:' || {_HMAC.format('c_name')} AS text_hash FROM customer")
def span_text_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", H.span_text_hash(_KEY, "c_name").alias("text_hash"))


@query(f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(CASE WHEN b < 30 THEN b - 30 ELSE b - 29 END AS INTEGER) AS shifted
FROM (SELECT o_orderkey, o_orderdate, {_hex(60, 'd')} AS b FROM (SELECT o_orderkey, o_orderdate, {_HMAC.format('o_custkey::VARCHAR')} AS d FROM orders))""")
def shift_dates_patient(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), H.date_shift_days(_KEY, "o_custkey", 30)).alias("shifted"))


@query("SELECT CAST(NULL AS BIGINT) AS l_orderkey, CAST(NULL AS INTEGER) AS l_linenumber WHERE false UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')")
def fk_orphans(spark, sf):
    from ..operators.relational import orphans

    parents = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return orphans(table(spark, sf, "lineitem"), "l_orderkey", parents, "o_orderkey").select("l_orderkey", "l_linenumber")
