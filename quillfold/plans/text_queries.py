"""Queries of the span, cohort and linking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import linking as L
from ..operators import spans as S
from .registry import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _sql(p: str) -> str:
    return p.replace("'", "''")


def _found(label: str) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all(text, '{_sql(S.PATTERNS[label])}', 2)) AS surface FROM documents"


def _register_surfaces(label: str) -> None:
    def run(spark, sf):
        return _docs(spark, sf).select("doc_id", F.explode(S.surfaces("text", label)).alias("surface"))

    query(_found(label), name=f"pii_{label.lower()}")(run)


for _label in ("EMAIL", "PHONE", "IPV4", "URL", "SSN", "DATE"):
    _register_surfaces(_label)

_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN substr(surface, i, 1)::INT WHEN substr(surface, i, 1)::INT * 2 > 9 THEN substr(surface, i, 1)::INT * 2 - 9 ELSE substr(surface, i, 1)::INT * 2 END)) % 10 = 0"


@query(f"SELECT doc_id, surface, {_LUHN} AS luhn_ok FROM ({_found('CARD')})")
def pii_card_luhn(spark, sf):
    from ..functions.validators import card

    found = _docs(spark, sf).select("doc_id", F.explode(S.surfaces("text", "CARD")).alias("surface"))
    return found.select("doc_id", "surface", card("surface").alias("luhn_ok"))


_LABELS = ["EMAIL", "PHONE", "IPV4", "CARD", "URL"]
_ALL = " UNION ALL ".join(f"SELECT doc_id, '{x}' AS label, surface FROM ({_found(x)})" for x in _LABELS)


@query(f"SELECT lang, label, count(*) AS n FROM ({_ALL}) JOIN documents USING (doc_id) GROUP BY CUBE (lang, label)")
def pii_counts_by_lang(spark, sf):
    return S.match_counts(_docs(spark, sf), _LABELS, "lang")


def _masked(expr: str, labels: list[str], style: str) -> str:
    for x in labels:
        expr = f"regexp_replace({expr}, '{_sql(S.PATTERNS[x])}', '\\1{'' if style == 'remove' else f'[{x}]'}', 'g')"
    return expr


@query(f"SELECT doc_id, {_masked('text', _LABELS, 'mask')} AS redacted FROM documents")
def redact_mask(spark, sf):
    return _docs(spark, sf).select("doc_id", S.mask_by_patterns("text", _LABELS).alias("redacted"))


@query(f"SELECT doc_id, length({_masked('text', _LABELS, 'remove')}) AS chars_left FROM documents")
def redact_remove(spark, sf):
    return _docs(spark, sf).select("doc_id", F.char_length(S.mask_by_patterns("text", _LABELS, "remove")).cast("long").alias("chars_left"))


def places(label: str) -> str:
    """Spans of a label in SQL: each match is split off from what is left of the text."""
    p = _sql(S.PATTERNS[label])
    return f"""SELECT doc_id, list_sum(list_transform(whole[1:i], lambda m: length(m))) + list_sum(list_transform(gaps[1:i], lambda g: length(g))) - length(inner_[i]) AS "start",
      list_sum(list_transform(whole[1:i], lambda m: length(m))) + list_sum(list_transform(gaps[1:i], lambda g: length(g))) AS "end", '{label}' AS label, inner_[i] AS surface
      FROM (SELECT doc_id, whole, inner_, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS whole, regexp_extract_all(text, '{p}', 2) AS inner_, regexp_split_to_array(text, '{p}') AS gaps FROM documents))"""


@query(f'SELECT doc_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", label, surface FROM ({places("EMAIL")} UNION ALL {places("URL")} UNION ALL {places("IPV4")})')
def span_offsets(spark, sf):
    return S.detect(_docs(spark, sf), ["EMAIL", "URL", "IPV4"], validate=False).select("doc_id", "start", "end", "label", "surface")


def _valid_spans(spark, sf):
    return S.detect(_docs(spark, sf), _LABELS, validate=False)


_SPANS = "SELECT * FROM (" + " UNION ALL ".join(places(x) for x in _LABELS) + ")"
_RANKED = f"""WITH s AS (SELECT *, CASE label {" ".join(f"WHEN '{n}' THEN {r}" for n, r, _ in S.POLICY)} ELSE 0 END AS rank FROM ({_SPANS})),
o AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS cluster FROM o)"""


@query(_RANKED + """ SELECT doc_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY rank DESC, "end" - "start" DESC, "start", label DESC) AS r FROM c) WHERE r = 1""")
def arbitrate_balanced(spark, sf):
    """Arbitration within the row, of spans that all score alike."""
    flat = F.transform("spans", lambda s: s.withField("score", F.lit(0.5)))
    found = S.with_spans(_docs(spark, sf).select("doc_id", "text"), "spans", _LABELS, validate=False).select("doc_id", flat.alias("spans"))
    return found.select("doc_id", F.explode(S.winners("spans")).alias("s")).select("doc_id", "s.start", "s.end", "s.label")


@query(_RANKED + """ SELECT doc_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY rank DESC, "end" - "start" DESC, "start", label DESC) AS r FROM c) WHERE r = 1""")
def arbitrate_span_table(spark, sf):
    """The same arbitration of a table of spans, as of several detectors."""
    return S.arbitrate_balanced(_valid_spans(spark, sf).withColumn("score", F.lit(0.5))).select("doc_id", "start", "end", "label")


@query(f'SELECT DISTINCT doc_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", label FROM ({_SPANS})')
def arbitrate_union(spark, sf):
    spans = _valid_spans(spark, sf)
    return S.arbitrate_union(spans.unionByName(spans)).select("doc_id", "start", "end", "label")


@query(f"""WITH s AS ({_SPANS}) SELECT a.doc_id, a.label AS left_label, b.label AS right_label, CAST(a."start" AS INTEGER) AS left_start, CAST(b."start" AS INTEGER) AS right_start
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a."start" < b."end" AND a."end" > b."start" WHERE a.label = 'URL' OR a.label = 'EMAIL'""")
def overlap_pairs(spark, sf):
    spans = _valid_spans(spark, sf)
    p = S.overlap_pairs(spans.where("label IN ('URL', 'EMAIL')"), spans)
    return p.select("doc_id", F.col("a.label").alias("left_label"), F.col("b.label").alias("right_label"), F.col("a.start").alias("left_start"), F.col("b.start").alias("right_start"))


@query(f"""WITH s AS ({_SPANS}) SELECT doc_id, CAST("start" AS INTEGER) AS "start", label FROM s WHERE label = 'CARD' AND NOT EXISTS (SELECT 1 FROM s a WHERE a.label = 'PHONE' AND a.doc_id = s.doc_id AND s."start" < a."end" AND s."end" > a."start")""")
def allowlist_anti(spark, sf):
    spans = _valid_spans(spark, sf)
    return S.suppress_allowed(spans.where("label = 'CARD'"), spans.where("label = 'PHONE'")).select("doc_id", "start", "label")


@query(f"""SELECT label, CASE label {" ".join(f"WHEN '{n}' THEN '{a}'" for n, _, a in S.POLICY)} ELSE 'mask' END AS action, count(*) AS n FROM ({_ALL}) GROUP BY ALL""")
def policy_actions_join(spark, sf):
    return S.apply_policy(_valid_spans(spark, sf)).groupBy("label", "action").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, label, CASE WHEN n = 1 THEN '[' || label || ']' ELSE '[' || label || '_' || n::VARCHAR || ']' END AS mask, CAST("start" AS INTEGER) AS "start"
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, label ORDER BY first_start, surface) AS n FROM (SELECT *, min("start") OVER (PARTITION BY doc_id, label, surface) AS first_start FROM ({_SPANS})))""")
def placeholder_numbers(spark, sf):
    return S.numbered_masks(_valid_spans(spark, sf)).select("doc_id", "label", "mask", "start")


@query(f"""SELECT doc_id, label || '_' || substr(sha256(surface), 1, 8) AS replacement FROM ({_found('EMAIL')}), (SELECT 'EMAIL' AS label)""")
def redact_hash_labels(spark, sf):
    spans = S.apply_policy(S.detect(_docs(spark, sf), ["EMAIL"], validate=False), [("EMAIL", 4, "hash")])
    return spans.select("doc_id", S.replacement().alias("replacement"))


_OCTETS = "list_min(list_transform(string_split(surface, '.'), lambda o: CASE WHEN o::INT <= 255 THEN 1 ELSE 0 END)) = 1"
_DIGITS = "regexp_replace(surface, '[^0-9]', '', 'g')"
_VALID = f"""SELECT * FROM ({_SPANS}) WHERE label IN ('EMAIL', 'URL') OR (label = 'CARD' AND {_LUHN}) OR (label = 'IPV4' AND {_OCTETS}) OR (label = 'PHONE' AND regexp_matches({_DIGITS}, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$'))"""


def _spliced(replacement: str, rows: str = _VALID) -> str:
    """The whole path in SQL: valid spans, the winner of each cluster, its replacement, the text put together again."""
    return _RANKED.replace(_SPANS, rows) + f""", w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY rank DESC, "end" - "start" DESC, "start", label DESC) AS r FROM c) WHERE r = 1),
g AS (SELECT doc_id, "start", "end", {replacement} AS new, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS before FROM w),
t AS (SELECT doc_id, count(*) AS n, max("end") AS last, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST("start" - before AS BIGINT)) || new, '' ORDER BY "start") AS head FROM g JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_spans, sha256(CASE WHEN n IS NULL THEN text ELSE head || substr(text, CAST(last + 1 AS BIGINT)) END) AS redacted_sha256 FROM documents LEFT JOIN t USING (doc_id)"""


@query(_spliced("CASE label WHEN 'CARD' THEN 'CARD_' || substr(sha256(surface), 1, 8) WHEN 'URL' THEN surface ELSE '[' || label || ']' END"))
def deidentify_documents(spark, sf):
    """The whole flagship path."""
    out = S.deidentify(_docs(spark, sf), _LABELS)
    return out.select("doc_id", "n_spans", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


@query(_spliced("''"))
def deidentify_remove(spark, sf):
    out = S.deidentify(_docs(spark, sf), _LABELS, method="remove")
    return out.select("doc_id", "n_spans", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


_KEY = b"example key"


def _hmac_sql(message: str) -> str:
    """HMAC-SHA-256 in DuckDB, in hexadecimal."""
    key = _KEY.ljust(64, b"\0")
    pad = lambda x: f"from_hex('{bytes(b ^ x for b in key).hex()}')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


_SURROGATE = f"""(SELECT CASE label WHEN 'EMAIL' THEN 'user.' || substr(d, 1, 10) || '@example.org' WHEN 'URL' THEN 'https://example.org/' || substr(d, 1, 12)
  ELSE '198.' || (('0x' || substr(d, 1, 2))::INT % 2 + 18) || '.' || ('0x' || substr(d, 3, 2))::INT || '.' || ('0x' || substr(d, 5, 2))::INT END
  FROM (SELECT {_hmac_sql("label || chr(31) || source || chr(31) || surface")} AS d))"""


@query(_spliced(_SURROGATE.replace("source", "(SELECT source FROM documents s WHERE s.doc_id = w.doc_id)"), f"SELECT * FROM ({_VALID}) WHERE label IN ('EMAIL', 'URL', 'IPV4')"))
def deidentify_replace(spark, sf):
    """Surrogates of the same kind, the same for equal surfaces of a source."""
    out = S.deidentify(_docs(spark, sf), ["EMAIL", "URL", "IPV4"], method="replace", secret=_KEY, subject_col="source")
    return out.select("doc_id", "n_spans", F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


_OFFSET = f"""(SELECT CASE WHEN b < 30 THEN b - 30 ELSE b - 29 END FROM (SELECT CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda k: ('0x' || substr(d, 8 * k + 1, 8))::BIGINT)), lambda a, x: (a * 4294967296 % 60 + x) % 60) AS INTEGER) AS b FROM (SELECT {_hmac_sql("l_suppkey::VARCHAR")} AS d)))"""


@query(f"""SELECT doc_id, 'Seen on ' || CAST(a + o AS VARCHAR) || ', due ' || CAST(a + 14 + o AS VARCHAR) || '; not [DATE].' AS redacted
FROM (SELECT l_orderkey * 10 + l_linenumber AS doc_id, CAST(l_shipdate AS DATE) AS a, o FROM lineitem JOIN (SELECT l_suppkey, {_OFFSET} AS o FROM (SELECT DISTINCT l_suppkey FROM lineitem)) USING (l_suppkey))""")
def deidentify_shift(spark, sf):
    """Dates inside texts, moved by their subject's days; what is no date is masked."""
    day = F.col("l_shipdate").cast("date")
    notes = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), "l_suppkey", F.concat(F.lit("Seen on "), day.cast("string"), F.lit(", due "), F.date_add(day, 14).cast("string"), F.lit("; not 2020-13-45.")).alias("text"))
    return S.deidentify(notes, ["DATE"], secret=_KEY, subject_col="l_suppkey", max_days=30).select("doc_id", "redacted")


_TRACE = _masked("text", ["EMAIL", "URL", "IPV4"], "mask")


@query(f"SELECT conv_id, turn, role, {_TRACE} AS redacted FROM conversations")
def trace_redact(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select("conv_id", "turn", "role", S.mask_by_patterns("text", ["EMAIL", "URL", "IPV4"]).alias("redacted"))


@query(f"""SELECT role, label, count(*) AS n FROM (SELECT role, unnest(['EMAIL', 'URL']) AS label, text FROM conversations) WHERE (label = 'EMAIL' AND regexp_matches(text, '{_sql(S.PATTERNS['EMAIL'])}')) OR (label = 'URL' AND regexp_matches(text, '{_sql(S.PATTERNS['URL'])}')) GROUP BY CUBE (role, label) HAVING count(*) > 0""")
def trace_counts(spark, sf):
    t = table(spark, sf, "conversations")
    marks = F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike(S.PATTERNS[x]), x) for x in ("EMAIL", "URL")))))
    return S.span_counts(t.select("role", marks.alias("label")), "role", "label").drop("gid")


# Cohorts: customers are persons, line items their events, by way of orders; part numbers modulo 40 are concepts.
_EVENTS = "SELECT o_custkey AS person_id, CAST(l_partkey % 40 AS BIGINT) AS concept_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS event_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _events(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("person_id"), (F.col("l_partkey") % 40).cast("long").alias("concept_id"), F.col("l_shipdate").cast("date").cast("string").alias("event_date"))


def _persons(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"))


def _phenotype(expression: dict) -> C.Phenotype:
    return C.parse({"id": "p", "name": "p", "concept_sets": [{"id": "a", "concept_ids": [1, 2, 3]}, {"id": "b", "concept_ids": [7]}], "expression": expression})


def _crit(name: str, cs: str, **extra) -> dict:
    return {"criterion": {"id": name, "concept_set": cs, **extra}}


_IN_A, _IN_B = f"SELECT person_id FROM ({_EVENTS}) WHERE concept_id IN (1, 2, 3)", f"SELECT person_id FROM ({_EVENTS}) WHERE concept_id = 7"


@query(f"{_IN_A} INTERSECT {_IN_B}")
def cohort_and(spark, sf):
    return C.resolve(_phenotype({"operator": "and", "children": [_crit("x", "a"), _crit("y", "b")]}), _persons(spark, sf), _events(spark, sf))


@query(f"{_IN_A} UNION {_IN_B}")
def cohort_or(spark, sf):
    return C.resolve(_phenotype({"operator": "or", "children": [_crit("x", "a"), _crit("y", "b")]}), _persons(spark, sf), _events(spark, sf))


@query(f"SELECT c_custkey AS person_id FROM customer EXCEPT ({_IN_A})")
def cohort_not(spark, sf):
    return C.resolve(_phenotype({"operator": "not", "children": [_crit("x", "a")]}), _persons(spark, sf), _events(spark, sf))


@query(f"SELECT person_id FROM ({_EVENTS}) WHERE concept_id IN (1, 2, 3) AND event_date BETWEEN '1994-01-01' AND '1997-12-31' GROUP BY person_id HAVING count(*) BETWEEN 2 AND 4")
def cohort_occurrence(spark, sf):
    e = _crit("x", "a", occurrence={"minimum": 2, "maximum": 4}, temporal={"start_date": "1994-01-01", "end_date": "1997-12-31"})
    return C.resolve(_phenotype(e), _persons(spark, sf), _events(spark, sf))


_NEAR = f"SELECT DISTINCT e.* FROM (SELECT * FROM ({_EVENTS}) WHERE concept_id = 7) e JOIN (SELECT * FROM ({_EVENTS}) WHERE concept_id IN (1, 2, 3)) a ON a.person_id = e.person_id AND date_diff('day', a.event_date::DATE, e.event_date::DATE) BETWEEN -30 AND 60"


def _anchored():
    return _phenotype({"operator": "and", "children": [_crit("x", "a"), _crit("y", "b", temporal={"anchor_criterion": "x", "days_before": 30, "days_after": 60})]})


@query(f"SELECT DISTINCT person_id FROM ({_NEAR})")
def cohort_temporal_anchor(spark, sf):
    return C.resolve(_anchored(), _persons(spark, sf), _events(spark, sf))


@query(f"""WITH e AS ({_EVENTS}), y AS (SELECT e.* FROM e WHERE concept_id = 7 AND EXISTS (SELECT 1 FROM e a WHERE a.concept_id IN (1, 2, 3) AND a.person_id = e.person_id AND date_diff('day', a.event_date::DATE, e.event_date::DATE) BETWEEN -30 AND 60)),
p AS (SELECT DISTINCT person_id FROM y)
SELECT 'x' AS criterion, * FROM e WHERE concept_id IN (1, 2, 3) AND person_id IN (SELECT person_id FROM p) UNION ALL SELECT 'y', * FROM y WHERE person_id IN (SELECT person_id FROM p)""")
def cohort_evidence(spark, sf):
    return C.evidence(_anchored(), _persons(spark, sf), _events(spark, sf))


@query(f"SELECT 'x' AS criterion, concept_id, count(DISTINCT person_id) AS persons, count(DISTINCT (person_id, event_date)) AS occurrences FROM ({_EVENTS}) WHERE concept_id IN (1, 2, 3) GROUP BY concept_id")
def cohort_provenance(spark, sf):
    return C.provenance(C.evidence(_phenotype(_crit("x", "a")), _persons(spark, sf), _events(spark, sf)))


_EDGES = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT x AS ancestor, x AS descendant FROM (SELECT parent AS x FROM e UNION SELECT child FROM e) UNION ALL SELECT r.ancestor, e.child FROM r JOIN e ON r.descendant = e.parent)
SELECT DISTINCT ancestor, descendant FROM r""")
def concept_descendants(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child")).unionByName(s.select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child")))
    return C.transitive_closure(edges, "parent", "child")


@query("""SELECT event_id, upper(trim(coalesce(CASE WHEN event_id % 5 = 0 THEN ' no ' END, 'Y'))) NOT IN ('N', 'NO', 'FALSE', '0') AS term_present, coalesce(json_extract_string(CASE WHEN event_id % 3 = 0 THEN '{"negation": "negated"}' ELSE '{"experiencer": "family"}' END, '$.negation'), 'affirmed') AS negation,
coalesce(json_extract_string(CASE WHEN event_id % 3 = 0 THEN '{"negation": "negated"}' ELSE '{"experiencer": "family"}' END, '$.experiencer'), 'patient') AS experiencer, 'recent' AS temporality, 'certain' AS certainty FROM events""")
def json_modifiers(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, '{"negation": "negated"}').otherwise('{"experiencer": "family"}').alias("term_modifiers"), F.when(F.col("event_id") % 5 == 0, " no ").alias("term_exists"))
    return C.asserted(e).drop("term_modifiers", "term_exists")


@query("SELECT 'orders' AS domain, o_custkey AS person_id, o_orderkey AS concept_id, CAST(o_orderdate AS VARCHAR)[1:10] AS day FROM orders UNION ALL SELECT 'lines', l_suppkey, l_partkey, CAST(l_shipdate AS VARCHAR)[1:10] FROM lineitem")
def domain_union(spark, sf):
    u = C.union_domains({"orders": (table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate"), "lines": (table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_shipdate")})
    return u.select("domain", "person_id", "concept_id", F.substring("event_date", 1, 10).alias("day"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dup_exact(spark, sf):
    return L.exact_duplicates(_docs(spark, sf))


_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'))"
#: Character shingles of each class of equal normalised texts, over all documents and whole texts.
_SHINGLES = f"""WITH d AS (SELECT doc_id, {_NORM} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT t, min(doc_id) AS class_id FROM d GROUP BY t),
x AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM (SELECT class_id, list_distinct(list_transform(range(1, greatest(length(t) - 4, 1) + 1), lambda i: hash(substr(t, i, 5)))) AS s FROM c))"""


@query(_SHINGLES + """, p AS (SELECT a.class_id, b.class_id AS other FROM x a JOIN x b ON a.g = b.g AND a.class_id <> b.class_id AND least(a.n, b.n) >= 0.92 * greatest(a.n, b.n) GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.92),
l AS (SELECT class_id, count(*) AS n_links FROM p GROUP BY class_id)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d JOIN c USING (t) LEFT JOIN l USING (class_id)""")
def dup_jaccard(spark, sf):
    """Each document's class of equal texts, and how many other classes are near copies of it."""
    return L.near_copies(_docs(spark, sf))


@query(_SHINGLES + """, p AS (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.g = b.g AND a.class_id < b.class_id AND b.n > a.n GROUP BY a.class_id, b.class_id, a.n HAVING count(*) / a.n >= 0.6),
m AS (SELECT b AS class_id, count(*) AS n_amends FROM p GROUP BY b), n AS (SELECT a AS class_id, count(*) AS n_amended FROM p GROUP BY a)
SELECT doc_id, class_id, coalesce(n_amends, 0) AS n_amends, coalesce(n_amended, 0) AS n_amended FROM d JOIN c USING (t) LEFT JOIN m USING (class_id) LEFT JOIN n USING (class_id)""")
def amendment_containment(spark, sf):
    """How many earlier documents each one amends, and how many later ones amend it."""
    return L.amendment_counts(_docs(spark, sf))


@query()
def version_links(spark, sf):
    """Near copies and amendments as pairs; tests hold it against brute force."""
    p = L.version_pairs(_docs(spark, sf))
    return p.withColumn("jaccard", F.round("jaccard", 6))


_GRAMS = "SELECT id, i AS pos, array_to_string(w[i + 1:i + 5], ' ') AS gram FROM (SELECT id, w, unnest(range(0, len(w) - 4)) AS i FROM (SELECT {0} AS id, string_split(" + _NORM + ", ' ') AS w FROM {1}) WHERE len(w) >= 5)"


@query(f"""WITH a AS ({_GRAMS.format('item_id', 'benchmark')}), b AS ({_GRAMS.format('doc_id', 'documents')}),
h AS (SELECT a.id AS earlier, b.id AS later, a.pos AS pa, b.pos AS pb FROM a JOIN b USING (gram)),
r AS (SELECT *, pa - row_number() OVER (PARTITION BY earlier, later, pa - pb ORDER BY pa) AS run FROM h)
SELECT earlier, later, min(pa) AS start_earlier, min(pb) AS start_later, count(*) + 4 AS words FROM r GROUP BY earlier, later, pa - pb, run HAVING count(*) + 4 >= 8""")
def copy_forward(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    out = L.copy_forward(items, _docs(spark, sf))
    return out.select("earlier", "later", F.col("start_earlier").cast("long").alias("start_earlier"), F.col("start_later").cast("long").alias("start_later"), F.col("words").cast("long").alias("words"))


@query("""SELECT sha256(line) AS line_digest, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE length(line) > 0 GROUP BY line HAVING count(DISTINCT doc_id) >= 5""")
def boilerplate_lines(spark, sf):
    return L.repeated_lines(_docs(spark, sf), 5)


@query("""SELECT doc_id, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS successor, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) IS NOT NULL AS is_superseded FROM documents""")
def document_lineage(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.concat("source", F.lit("/"), "lang").alias("cluster"), "n_chars")
    return L.superseded(d, "cluster", "n_chars").select("doc_id", "successor", "is_superseded")


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id),
r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def doc_components(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.xxhash64("text").alias("h"), "text")
    first = d.groupBy("text").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    edges = d.join(first, "text").select("u", F.col("doc_id").alias("v"))
    return L.label_components(edges, edges.select(F.col("v").alias("node")))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS visible FROM pages""")
def html_visible_text(spark, sf):
    from ..sources.html import visible_text

    return table(spark, sf, "pages").select("page_id", visible_text("html").alias("visible"))
