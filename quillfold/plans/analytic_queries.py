"""Queries of the clinical, grounding, evaluation, release and window operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import clinical as K
from ..functions import validators as V
from ..operators import clinical as O
from ..operators import dp as D
from ..operators import entities as N
from ..operators import grounding as G
from ..operators import lattice as T
from ..operators import metrics as M
from ..streaming import events as E
from .registry import query, table


def _values(spark, rows: list[tuple], names: str):
    return spark.createDataFrame(rows, names)


def _sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


#: Short phrases are built from the columns of ``lineitem``; the oracles work the answers out of the same columns.
_LINE = "l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_quantity, l_suppkey, l_partkey"
_LINES = f"(SELECT {_LINE} FROM lineitem)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_LINE.split(", "))


def _text(value) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _phrase(number: Column, forms: list[tuple]) -> Column:
    """The form of that number, counted around: each is a tuple of strings and columns to join."""
    out = F.lit(None).cast("string")
    for i, parts in enumerate(forms):
        out = F.when(number % len(forms) == i, F.concat(*map(_text, parts))).otherwise(out)
    return out


@query(f"""SELECT id, CASE q % 9 WHEN 0 THEN 'blood_pressure' WHEN 1 THEN 'oxygen_saturation' WHEN 2 THEN 'body_temperature' WHEN 3 THEN 'respiratory_rate' WHEN 7 THEN 'unknown' WHEN 8 THEN 'oxygen_saturation' ELSE 'heart_rate' END AS kind,
CASE WHEN q % 9 IN (0, 7) THEN NULL WHEN q % 9 = 2 THEN q + 0.5 ELSE q END::DOUBLE AS value, CASE WHEN q % 9 = 0 THEN 100 + q END::DOUBLE AS systolic, CASE WHEN q % 9 = 0 THEN 50 + q END::DOUBLE AS diastolic,
CASE q % 9 WHEN 0 THEN 'mmhg' WHEN 1 THEN '%' WHEN 2 THEN 'c' WHEN 3 THEN '/min' WHEN 4 THEN 'beats per minute' WHEN 6 THEN 'bpm' ELSE '' END AS unit FROM {_LINES}""")
def vitals_parse(spark, sf):
    q = F.col("q")
    forms = [("BP ", q + 100, "/", q + 50, " mmHg lying"), ("SpO2 ", q, "% on RA"), ("Temperature is ", q, ".5 C."), ("RR: ", q, "/min,"), ("pulse ", q, " beats per minute"), ("Heart rate = ", q, " today"), ("resting at ", q, " bpm"), ("weight ", q, " kg, no vitals"), ("O2 sat was ", q)]
    return _lines(spark, sf).select("id", _phrase(q, forms).alias("phrase")).select("id", K.vital_sign("phrase").alias("v")).select("id", "v.*")


@query(f"""SELECT id, CASE WHEN l_linenumber = 7 THEN 'high' WHEN l_linenumber = 6 AND l_suppkey % 2 = 0 THEN 'unknown' ELSE CASE l_suppkey % 7
WHEN 0 THEN CASE WHEN q < 10 THEN 'low' WHEN q > 30 THEN 'high' ELSE 'normal' END WHEN 1 THEN CASE WHEN q < 12.5 THEN 'low' WHEN q > 40 THEN 'high' ELSE 'normal' END WHEN 2 THEN CASE WHEN q >= 25 THEN 'high' ELSE 'normal' END
WHEN 3 THEN CASE WHEN q > 25 THEN 'high' ELSE 'normal' END WHEN 4 THEN CASE WHEN q <= 20 THEN 'low' ELSE 'normal' END WHEN 5 THEN CASE WHEN q < 20 THEN 'low' ELSE 'normal' END ELSE 'unknown' END END AS flag FROM {_LINES}""")
def refrange_flag(spark, sf):
    forms = [("10-30",), ("12.5 to 40 mmol/L",), ("<25",), (" <= 25 mg/dL",), (">20",), (">=20",), ("30-10",)]
    stated = F.when(F.col("l_linenumber") == 7, " hh ".replace("hh", "H")).when((F.col("l_linenumber") == 6) & (F.col("l_suppkey") % 2 == 0), "zz")
    r = _lines(spark, sf).withColumn("t", _phrase(F.col("l_suppkey"), forms)).withColumn("r", K.reference_range("t")).withColumn("stated", stated)
    return r.select("id", K.abnormal_flag(F.col("l_quantity"), F.col("r"), F.col("stated")).alias("flag"))


@query(f"""SELECT id, CASE WHEN f = 4 THEN NULL ELSE q END::DOUBLE AS dose, CASE f WHEN 1 THEN 'mg' WHEN 3 THEN 'ml' END AS unit, CASE f WHEN 0 THEN 'tablet' WHEN 2 THEN 'puff' END AS form,
CASE f WHEN 0 THEN 'oral' WHEN 1 THEN 'intravenous' WHEN 2 THEN 'inhaled' WHEN 3 THEN 'oral' END AS route, CASE f WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN h > 0 THEN 24.0 / h END WHEN 2 THEN 1 WHEN 3 THEN 4 END::DOUBLE AS frequency_per_day,
f = 1 AS as_needed, CASE f WHEN 0 THEN q WHEN 3 THEN 7 * q END::INTEGER AS duration_days, CASE WHEN f = 4 THEN 'dose,route,frequency' ELSE '' END AS missing FROM (SELECT id, q, l_suppkey % 5 AS f, l_linenumber AS h FROM {_LINES})""")
def sig_parse(spark, sf):
    q, h = F.col("q"), F.col("l_linenumber")
    forms = [(q, " tabs PO BID x", q, " days"), (q, " mg IV q", h, "h prn pain"), (q, " puffs inhaled daily"), (q, " ml by mouth qid for ", q, " weeks"), ("as directed, max ", q, " days, before", q)]
    s = _lines(spark, sf).select("id", _phrase(F.col("l_suppkey"), forms).alias("t"))
    s = O.parsed(s, "t", K.sig, "s").select("id", "s.*")
    return s.withColumn("missing", F.array_join("missing", ","))


_CUES, _LINKS, _TERMS = ("No", "denies", "without", "has", "cannot be ruled out:"), (", ", " but ", "; ", " and ", ", or "), ("chest pain", "fever", "naïve cough", "edema")


@query(f"""SELECT id, c < 3 AS first_negated, (c < 3 AND k = 0) OR tail = 1 AS second_negated, c >= 3 AND tail = 2 AS third_negated FROM (SELECT id, q % 5 AS c, l_suppkey % 5 AS k, l_partkey % 3 AS tail FROM {_LINES})""")
def negation_scope(spark, sf):
    """Two findings behind a cue and a link, then perhaps a cue that looks back, and a finding named twice."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    one, two = pick(_TERMS[:2], F.col("l_linenumber")), pick(_TERMS[2:], F.col("l_linenumber"))
    back = F.when(F.col("l_partkey") % 3 == 1, F.lit(" ruled out.")).otherwise(F.lit(" today."))
    again = F.when(F.col("l_partkey") % 3 == 2, F.lit(" Rash absent.")).otherwise(F.lit(" Rash seen. No rash."))
    stop = F.when((F.col("l_partkey") % 3 == 1) & (F.col("l_suppkey") % 5 == 0), F.lit(". Now ")).otherwise(pick(_LINKS, F.col("l_suppkey")))
    text = F.concat(pick(_CUES, F.col("q")), F.lit(" "), one, stop, two, back, again)
    rows = _lines(spark, sf).select("id", "q", text.alias("text"), one.alias("one"), two.alias("two"))
    return rows.select("id", K.is_negated("text", "one").alias("first_negated"), K.is_negated("text", "two").alias("second_negated"), (K.is_negated("text", F.lit("rash")) & (F.col("q") % 5 >= 3)).alias("third_negated"))


@query(f"""SELECT id, CASE l_linenumber WHEN 1 THEN l_quantity * 1000 WHEN 2 THEN (l_quantity - 32) * 5 / 9 WHEN 5 THEN l_quantity * 60 WHEN 6 THEN l_quantity + 273.15 WHEN 7 THEN l_quantity * 2.54 END::DOUBLE AS value,
CASE l_linenumber WHEN 3 THEN 'incommensurable' WHEN 4 THEN 'unknown_unit' ELSE 'converted' END AS status FROM {_LINES}""")
def units_convert(spark, sf):
    pairs = [("[in_i]", "cm"), ("g", "mg"), ("[degF]", "Cel"), ("mg", "mL"), ("unit", "mg"), ("h", "min"), ("Cel", "K")]
    a, b = (_phrase(F.col("l_linenumber"), [(p[i],) for p in pairs]) for i in (0, 1))
    rows = _lines(spark, sf).select("id", "l_quantity", a.alias("a"), b.alias("b"))
    return rows.select("id", K.convert_unit(F.col("l_quantity"), F.col("a"), F.col("b")).alias("c")).select("id", F.round("c.value", 6).alias("value"), "c.status")


_LUHN_SUM = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT WHEN substr(d, i, 1)::INT > 4 THEN substr(d, i, 1)::INT * 2 - 9 ELSE substr(d, i, 1)::INT * 2 END)) % 10 = 0"
_VERHOEFF = f"""list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: {[[int(c) for c in r] for r in V.VERHOEFF_P]}[i % 8 + 1][substr(reverse(e), i + 1, 1)::INT + 1])), lambda acc, x: {[[int(c) for c in r] for r in V.VERHOEFF_D]}[acc + 1][x + 1]) = 0"""


@query(f"""SELECT id, substr(a, 1, 3) NOT IN ('000', '666') AND substr(a, 1, 1) <> '9' AND substr(a, 4, 2) <> '00' AND substr(a, 6, 4) <> '0000' AS ssn, (SELECT {_LUHN_SUM} FROM (SELECT b AS d)) AS card, (SELECT {_LUHN_SUM} FROM (SELECT '80840' || c AS d)) AS npi, (c || '1611' || '00')::HUGEINT % 97 = 98 - k::INT AS iban, {_VERHOEFF} AS verhoeff
FROM (SELECT id, lpad((id * 7919 % 1000000000)::VARCHAR, 9, '0') AS a, lpad((id * 104729)::VARCHAR, 16, '4') AS b, lpad((id * 31 % 10000000000)::VARCHAR, 10, '1') AS c, lpad((id % 96 + 2)::VARCHAR, 2, '0') AS k, lpad((id * 17)::VARCHAR, 12, '2') AS e FROM {_LINES})""")
def identifier_checks(spark, sf):
    digits = lambda c, n, fill: F.lpad(c.cast("string"), n, fill)
    i = F.col("id")
    a, c = digits(i * 7919 % 1000000000, 9, "0"), digits(i * 31 % 10000000000, 10, "1")
    iban = F.concat(F.lit("GB"), digits(i % 96 + 2, 2, "0"), F.lit(" "), F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 6))
    return _lines(spark, sf).select("id", V.ssn(F.concat(F.substring(a, 1, 3), F.lit("-"), F.substring(a, 4, 2), F.lit("-"), F.substring(a, 6, 4))).alias("ssn"), V.card(digits(i * 104729, 16, "4")).alias("card"), V.npi(c).alias("npi"), V.iban(iban).alias("iban"), V.verhoeff(digits(i * 17, 12, "2")).alias("verhoeff"))


@query(f"""SELECT id, CASE l_partkey % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'other' ELSE 'patient' END AS experiencer, CASE l_suppkey % 4 WHEN 0 THEN 'mild' WHEN 1 THEN 'severe' END AS severity, CASE l_linenumber % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'bilateral' END AS laterality FROM {_LINES}""")
def span_modifiers(spark, sf):
    """Whose, how grave and on which side: words near a span in its sentence."""
    n = lambda c, k: F.col(c) % k
    who = F.when(n("l_partkey", 4) == 0, "Her mother had ").when(n("l_partkey", 4) == 1, "The donor had ").when(n("l_partkey", 4) == 2, "Father. Patient has ").otherwise("Reports ")
    how = F.when(n("l_suppkey", 4) == 0, "slight ").when(n("l_suppkey", 4) == 1, "marked ").otherwise("")
    side = F.when(n("l_linenumber", 3) == 0, " on the left").when(n("l_linenumber", 3) == 1, " of both sides").otherwise("; right hip fine")
    head = F.concat(who, how)
    rows = _lines(spark, sf).select("id", F.concat(head, F.lit("swelling"), side, F.lit(". Severe pain elsewhere, right.")).alias("text"), F.char_length(head).alias("a"), (F.char_length(head) + 8).alias("b"))
    return rows.select("id", *(f("text", F.col("a"), F.col("b")).alias(f.__name__) for f in (K.experiencer, K.severity, K.laterality)))


@query("""SELECT event_id, 'event type' AS key, event_type AS value, 0 AS line FROM events UNION ALL SELECT event_id, 'user', 'no. ' || user_id, 2 FROM events UNION ALL SELECT event_id, 'value', CAST(user_id AS VARCHAR) || ' = ' || event_id, 3 FROM events""")
def form_fields(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("Event Type: "), "event_type", F.lit("\njust a line without fields\n  user =  no. "), F.col("user_id").cast("string"), F.lit(" \nValue: "), F.col("user_id").cast("string"), F.lit(" = "), F.col("event_id").cast("string"), F.lit("\n: none\nempty:"))
    return e.select("event_id", F.explode(K.key_values(text)).alias("f")).select("event_id", "f.key", "f.value", "f.line")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (length(trim(line, ' ')) > 0) AS full_lines FROM l GROUP BY doc_id""")
def list_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.length(F.trim("line")) > 0).alias("full_lines"))


@query(r"""SELECT doc_id, count(*) AS sentences FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents) WHERE length(trim(s, ' ')) > 0 GROUP BY doc_id""")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(K.sentences("text")).cast("long").alias("sentences"))


_POINTS = "SELECT event_type || '/' || (user_id % 50)::VARCHAR AS entity, date_trunc('day', ts) AS t, round(avg(value), 3) AS v FROM events GROUP BY ALL"


@query(f"""WITH p AS ({_POINTS}), s AS (SELECT *, v - lag(v) OVER w AS d, lag(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY entity ORDER BY t)),
g AS (SELECT entity, count(*) AS n, arg_min(v, t) AS first, arg_max(v, t) AS last, count(*) FILTER (d > greatest(1e-12, 1e-9 * greatest(abs(b), abs(v)))) AS ups, count(*) FILTER (-d > greatest(1e-12, 1e-9 * greatest(abs(b), abs(v)))) AS downs FROM s GROUP BY entity)
SELECT entity, n, first, last, round(last - first, 6) AS delta, CASE WHEN n < 2 THEN 'unknown' WHEN ups > 0 AND downs > 0 THEN 'mixed' WHEN ups > 0 THEN 'up' WHEN downs > 0 THEN 'down' ELSE 'flat' END AS direction FROM g""")
def serial_trend(spark, sf):
    e = table(spark, sf, "events").groupBy(F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("entity"), F.date_trunc("day", "ts").alias("t")).agg(F.round(F.avg("value"), 3).alias("v"))
    return O.trend(e, "entity", "t", "v").withColumn("delta", F.round("delta", 6))


@query("""SELECT user_id AS subject, event_type AS key, d AS at, n AS mentions, dense_rank() OVER (PARTITION BY user_id ORDER BY d) AS place FROM (SELECT user_id, lower(event_type) AS event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL)""")
def timeline_order(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("d"))
    return O.timeline(e, "user_id", "event_type", "d").select("subject", "key", "at", "mentions", F.col("place").cast("long").alias("place"))


@query("SELECT slot, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM (SELECT date_trunc('hour', ts) AS slot, event_type, value FROM events) GROUP BY slot")
def flowsheet_pivot(spark, sf):
    return O.flowsheet(table(spark, sf, "events"), F.date_trunc("hour", "ts"), "event_type", ["click", "view", "purchase"], "value")


_PROBLEMS = """SELECT o_custkey AS subject, o_orderpriority AS text, CASE WHEN o_orderkey % 3 = 0 THEN 's' END AS system, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 5)::VARCHAR END AS code, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'inactive' ELSE 'unconfirmed' END AS status, o_orderkey AS "offset" FROM orders"""


@query(f"""WITH m AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'c:' || system || '|' || code ELSE 't:' || lower(trim(text)) END AS problem, CASE status WHEN 'active' THEN 1 WHEN 'inactive' THEN 2 ELSE 3 END AS r FROM ({_PROBLEMS}))
SELECT subject, problem, arg_min(status, r::BIGINT * 1000000000 + "offset") AS status, arg_min(text, "offset") AS text, count(*) AS mentions, min("offset") AS first_offset FROM m GROUP BY subject, problem""")
def problem_list(spark, sf):
    o = table(spark, sf, "orders")
    coded = F.col("o_orderkey") % 3 == 0
    m = o.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("text"), F.when(coded, "s").alias("system"), F.when(coded, (F.col("o_orderkey") % 5).cast("string")).alias("code"), F.lit(None).cast("string").alias("coref"), F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "inactive").otherwise("unconfirmed").alias("status"), F.col("o_orderkey").alias("offset"))
    return O.problem_list(m)


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) <= 1 THEN min(event_type) END AS event_type, CASE WHEN count(DISTINCT event_type) > 1 THEN 'unconfirmed' ELSE 'confirmed' END AS status FROM events WHERE event_id % 4 <> 0 GROUP BY user_id""")
def assertion_reconcile(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.when(F.col("event_id") % 4 == 0, "family").alias("experiencer"))
    return O.reconcile_assertions(e, ["user_id"], ["event_type"])


_PAIRS = [(1, 2, "major"), (5, 3, "minor"), (7, 9, "moderate"), (11, 4, "major")]


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey AS subject, l_partkey % 15 AS code FROM lineitem), r AS (SELECT least(a, b) AS a, greatest(a, b) AS b, severity FROM {_sql_values(_PAIRS, 'a, b, severity')})
SELECT x.subject, x.code AS a, y.code AS b, r.severity FROM d x JOIN d y ON x.subject = y.subject AND x.code < y.code JOIN r ON r.a = x.code AND r.b = y.code""")
def interaction_pairs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 15).alias("code"))
    return O.interaction_pairs(li, _values(spark, _PAIRS, "a long, b long, severity string"), "l_orderkey", "code").select("subject", "a", "b", "severity")


_LIMITS = [(1, 5.0, 20.0), (2, 10.0, 30.0), (3, None, 25.0)]


@query(f"""SELECT "check", count(*) AS n FROM (SELECT CASE WHEN low IS NULL AND high IS NULL THEN 'not_checked' WHEN l_quantity < low THEN 'below' WHEN l_quantity > high THEN 'above' ELSE 'within' END AS "check" FROM lineitem LEFT JOIN {_sql_values(_LIMITS, 'drug, low, high')} ON drug = l_partkey % 5) GROUP BY 1""")
def dose_range_check(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_partkey") % 5).alias("drug"), "l_quantity")
    return O.dose_check(li, _values(spark, _LIMITS, "drug long, low double, high double"), ["drug"], "l_quantity").groupBy("check").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_returnflag, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list(l_discount ORDER BY l_discount)), lambda a, s: a * (1 - s)), 6) AS score, count(*) AS sentences FROM lineitem GROUP BY ALL""")
def document_relations(spark, sf):
    return O.noisy_or(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], "l_discount")


_PANEL = [("basic", "click"), ("basic", "view"), ("extra", "purchase")]


@query(f"""SELECT day, panel, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS analytes, count(DISTINCT event_type) = max(size) AS complete FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events) JOIN (SELECT *, count(*) OVER (PARTITION BY panel) AS size FROM {_sql_values(_PANEL, 'panel, analyte')}) ON analyte = event_type GROUP BY day, panel""")
def lab_panels(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type")
    return O.panels(e, _values(spark, _PANEL, "panel string, analyte string"), ["day"], "event_type").withColumn("analytes", F.array_join("analytes", ","))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber AS id, l_linenumber * 10 AS s, l_linenumber * 10 + 3 AS e FROM lineitem WHERE l_linenumber % 2 = 1), a AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS id, l_linenumber * 10 AS s, l_linenumber * 10 + 2 AS e FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT id, head_id FROM (SELECT a.id, h.id AS head_id, row_number() OVER (PARTITION BY a.id ORDER BY greatest(a.s - h.e, h.s - a.e, 0), h.s, h.id) AS r FROM a JOIN h USING (l_orderkey)) WHERE r = 1""")
def attribute_links(spark, sf):
    li = table(spark, sf, "lineitem")
    at = F.col("l_linenumber") * 10
    heads = li.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("id"), at.alias("start"), (at + 3).alias("end"))
    attrs = li.where("l_linenumber % 2 = 0").select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), at.alias("start"), (at + 2).alias("end"))
    return O.link_attributes(heads, attrs, ["l_orderkey"]).select("id", "head_id")


@query(f"""WITH a AS (SELECT n_name AS alias, 'N' || n_nationkey AS code FROM nation), m AS (SELECT s_suppkey AS mention_id, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE lower(n_name) || '!' END AS surface FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT mention_id, code, 1.0 AS score, 'exact' AS tier FROM m JOIN a ON surface = alias UNION ALL SELECT mention_id, code, 0.95, 'normalized' FROM m JOIN a ON trim(regexp_replace(lower(surface), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')))
SELECT mention_id, code, CAST(score AS DOUBLE) AS score, tier FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, code) AS r FROM x) WHERE r = 1""")
def lexical_match(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    aliases = n.select(F.col("n_name").alias("alias"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    m = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("mention_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit("!"))).alias("surface"))
    return G.lexical_match(m, aliases)


_GRAM = "list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))"
_NORMAL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH a0 AS (SELECT DISTINCT n_name AS key FROM nation), q0 AS (SELECT s_suppkey AS key, s_name AS txt FROM supplier),
a AS (SELECT key, g, count(*) AS tf FROM (SELECT key, unnest({_GRAM}) AS g FROM (SELECT key, '  ' || {_NORMAL.format('key')} || ' ' AS t FROM a0)) GROUP BY ALL),
q AS (SELECT key, g, count(*) AS tf FROM (SELECT key, unnest({_GRAM}) AS g FROM (SELECT key, '  ' || {_NORMAL.format('txt')} || ' ' AS t FROM q0)) GROUP BY ALL),
f AS (SELECT g, count(*) AS df FROM a GROUP BY g), n AS (SELECT count(*) AS N FROM a0),
aw AS (SELECT key, g, tf * (ln((1 + N) / (1 + coalesce(df, 0))) + 1) AS w FROM a LEFT JOIN f USING (g), n), qw AS (SELECT key, g, tf * (ln((1 + N) / (1 + coalesce(df, 0))) + 1) AS w FROM q LEFT JOIN f USING (g), n),
d AS (SELECT qw.key AS mention_id, aw.key AS alias, sum(qw.w * aw.w) AS dot FROM qw JOIN aw USING (g) GROUP BY ALL),
s AS (SELECT mention_id, alias, round(dot / (x.n * y.n), 6) AS sim FROM d JOIN (SELECT key, sqrt(sum(w * w)) AS n FROM qw GROUP BY key) x ON x.key = mention_id JOIN (SELECT key, sqrt(sum(w * w)) AS n FROM aw GROUP BY key) y ON y.key = alias)
SELECT mention_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY sim DESC, alias) AS rank FROM s) WHERE rank <= 3""")
def sparse_trigram_match(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    found = G.sparse_match(s.select(F.col("s_suppkey").alias("mention_id"), F.col("s_name").alias("surface")), n.select(F.col("n_name").alias("alias")))
    return found.select("mention_id", "sim", "rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def dense_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return G.dense_top_k(v.where("vec_id % 20 = 0"), v, 5)


@query("SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim")
def label_centroid(spark, sf):
    return G.centroids(table(spark, sf, "embeddings"), "label")


_GOLD = "SELECT l_orderkey AS doc_id, l_linenumber AS s, l_linenumber + 3 AS e, l_returnflag AS label FROM lineitem WHERE l_partkey % 7 <> 0"
_PRED = "SELECT l_orderkey AS doc_id, l_linenumber AS s, l_linenumber + 3 AS e, l_returnflag AS label FROM lineitem WHERE l_partkey % 5 <> 0"


def _spans(spark, sf, n):
    return table(spark, sf, "lineitem").where(f"l_partkey % {n} <> 0").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("end"), F.col("l_returnflag").alias("label"))


@query(f"""WITH g AS (SELECT DISTINCT * FROM ({_GOLD})), p AS (SELECT DISTINCT * FROM ({_PRED})), b AS (SELECT label, g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p FROM g FULL JOIN p USING (doc_id, s, e, label)),
c AS (SELECT label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY label)
SELECT label, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def span_f1(spark, sf):
    r = M.exact_span_scores(_spans(spark, sf, 7), _spans(spark, sf, 5), ["label"])
    return r.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT l_returnflag, l_linestatus, count(*) FILTER (NOT (l_partkey % 9 <> 0)) AS missed, count(*) AS total, round(count(*) FILTER (NOT (l_partkey % 9 <> 0)) / count(*), 6) AS leakage FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def leakage_cube(spark, sf):
    s = table(spark, sf, "lineitem").withColumn("found", F.col("l_partkey") % 9 != 0)
    return M.leakage_heatmap(s, "l_returnflag", "l_linestatus").withColumn("leakage", F.round("leakage", 6))


@query("""WITH h AS (SELECT event_type AS b, count(*) FILTER (event_id % 2 = 0) AS x, count(*) FILTER (event_id % 3 = 0) AS y FROM events GROUP BY 1), t AS (SELECT sum(x) AS tx, sum(y) AS ty FROM h)
SELECT round(sum(((y / ty + 1e-6) - (x / tx + 1e-6)) * ln((y / ty + 1e-6) / (x / tx + 1e-6))), 9) AS psi FROM h, t""")
def drift_psi(spark, sf):
    e = table(spark, sf, "events")
    return M.population_stability(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "event_type").select(F.round("psi", 9).alias("psi"))


@query("""WITH t AS (SELECT c_custkey AS k, c_nationkey AS g, (c_custkey * 7919 % 1000 + 1) / 1000 AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, k) AS i, count(*) OVER (PARTITION BY g) AS m FROM t),
a AS (SELECT k, least(1.0, min(p * m / i) OVER (PARTITION BY g ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted FROM r)
SELECT k, round(adjusted, 9) AS adjusted, adjusted <= 0.05 AS rejected FROM a""")
def fdr_bh(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), ((F.col("c_custkey") * 7919 % 1000 + 1) / 1000).alias("p"))
    return M.benjamini_hochberg(t, "k", "p", ["g"]).select("k", F.round("adjusted", 9).alias("adjusted"), "rejected")


@query("""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(n) FILTER (a = b) AS same FROM c),
m AS (SELECT sum(x * y) AS chance FROM (SELECT a, sum(n) AS x FROM c GROUP BY a) JOIN (SELECT b AS a, sum(n) AS y FROM c GROUP BY b) USING (a))
SELECT CAST(total AS BIGINT) AS n, round(same / total, 6) AS agreement, round((same / total - chance / (total * total)) / (1 - chance / (total * total)), 6) AS kappa FROM t, m""")
def kappa_labels(spark, sf):
    r = M.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic")
    return r.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""WITH c AS (SELECT o_custkey AS i, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT i, sum(n) AS m, sum(n * (n - 1)) AS agree FROM c GROUP BY i HAVING sum(n) > 1), k AS (SELECT c.* FROM c JOIN e USING (i)), s AS (SELECT sum(x * x) AS sq FROM (SELECT sum(n) AS x FROM k GROUP BY c))
SELECT round((avg(agree / (m * (m - 1))) - max(sq) / (sum(m) * sum(m))) / (1 - max(sq) / (sum(m) * sum(m))), 6) AS kappa FROM e, s""")
def fleiss_priorities(spark, sf):
    o = table(spark, sf, "orders")
    several = o.groupBy("o_custkey").agg(F.count("*").alias("m")).where("m > 1").select("o_custkey")
    return M.fleiss_kappa(o.join(several, "o_custkey", "left_semi"), "o_custkey", "o_orderpriority").select(F.round("kappa", 6).alias("kappa"))


@query("""WITH m AS (SELECT c_nationkey AS g, c_custkey % 30 AS p FROM customer), x AS (SELECT g, p, count(*) AS n FROM m GROUP BY ALL), y AS (SELECT *, sum(n) OVER (PARTITION BY g) AS ng, sum(n) OVER (PARTITION BY p) AS np FROM x), z AS (SELECT sum(n * n / np) / sum(n) AS pr, sum(n * n / ng) / sum(n) AS re FROM y)
SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM z""")
def bcubed(spark, sf):
    c = table(spark, sf, "customer")
    r = M.b_cubed(c.select(F.col("c_custkey").alias("mention"), F.col("c_nationkey").alias("cluster")), c.select(F.col("c_custkey").alias("mention"), (F.col("c_custkey") % 30).alias("cluster")))
    return r.select(*(F.round(x, 6).alias(x) for x in r.columns))


@query("""WITH t AS (SELECT unnest([0.25, 0.5, 0.75]) AS threshold), c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold AND NOT y) AS fp, count(*) FILTER (s < threshold AND y) AS fn FROM (SELECT (doc_id * 37 % 100) / 100 AS s, quality = 1 AS y FROM labels), t GROUP BY 1)
SELECT threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def threshold_sweep(spark, sf):
    s = table(spark, sf, "labels").select((F.col("doc_id") * 37 % 100 / 100).alias("s"), (F.col("quality") == 1).alias("y"))
    r = M.threshold_sweep(s, [0.25, 0.5, 0.75], "s", "y")
    return r.select("threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH a AS (SELECT floor(value) AS v, event_id % 2 = 0 AS e FROM events), h AS (SELECT v, count(*) FILTER (e) AS a, count(*) FILTER (NOT e) AS b FROM a WHERE v IS NOT NULL GROUP BY v), c AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS x, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS y FROM h)
SELECT round(max(abs(x - y)), 9) AS ks FROM c""")
def fidelity_ks(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", F.floor("value").alias("v"))
    return M.ks_statistic(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), "v").select(F.round("ks", 9).alias("ks"))


@query("""WITH h AS (SELECT c_mktsegment, count(*) FILTER (c_custkey % 2 = 0) AS a, count(*) FILTER (c_custkey % 2 <> 0) AS b FROM customer GROUP BY 1) SELECT round(0.5 * sum(abs(a / ta - b / tb)), 9) AS tv FROM h, (SELECT sum(a) AS ta, sum(b) AS tb FROM h)""")
def fidelity_tv(spark, sf):
    c = table(spark, sf, "customer")
    return M.total_variation(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 <> 0"), "c_mktsegment").select(F.round("tv", 9).alias("tv"))


@query("""WITH h AS (SELECT (doc_id * 13) % 50 AS s, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM labels GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 9) AS auc, round(2 * sum(p * (below + n / 2)) / (sum(p) * sum(n)) - 1, 9) AS advantage FROM w""")
def membership_auc(spark, sf):
    s = table(spark, sf, "labels").select((F.col("doc_id") * 13 % 50).alias("s"), (F.col("toxic") == 1).alias("m"))
    r = M.rank_auc(s, "s", "m")
    return r.select(F.round("auc", 9).alias("auc"), F.round("advantage", 9).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, l_tax + 1 AS t FROM lineitem WHERE l_orderkey % 10 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_orderkey % 10 BETWEEN 1 AND 8) ON k = l_orderkey AND n = l_linenumber WHERE k IS NULL OR t <> l_tax""")
def audit_diff(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    after = li.where("l_orderkey % 10 <> 9").withColumn("l_tax", F.when(F.col("l_orderkey") % 10 == 0, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return M.table_diff(li, after, ["l_orderkey", "l_linenumber"], ["l_tax"])


@query("""SELECT event_type, count(value) AS n, round(sum(greatest(0.0, least(50.0, value))), 4) AS total FROM events GROUP BY event_type""")
def dp_bounded_aggregates(spark, sf):
    return D.bounded_aggregates(table(spark, sf, "events"), "value", 0, 50, ["event_type"]).withColumn("total", F.round("total", 4))


@query("""SELECT CAST(e AS DOUBLE) AS epsilon, round(10.0 / e, 9) AS expected_error, round(10.0 / e * sqrt(2), 9) AS sd FROM (SELECT unnest([0.1, 0.5, 1.0, 2.0])::DOUBLE AS e)""")
def dp_scales(spark, sf):
    r = D.utility_curve(spark, [0.1, 0.5, 1.0, 2.0], 10.0)
    return r.select("epsilon", F.round("expected_error", 9).alias("expected_error"), F.round("sd", 9).alias("sd"))


_DRAW = "(('0x' || substr(sha256('7' || chr(31) || 'release' || chr(31) || '{0}' || chr(31) || event_type), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
_CLAMPED = "SELECT event_type, count(value) AS n, sum(greatest(0, least(50, value))) AS total FROM events GROUP BY event_type"


def _noisy_sql(n: str, total: str) -> str:
    return f"""SELECT event_type, round(n, 6) AS n, round(total, 4) AS total, round(least(50, greatest(0, total / greatest(n, 1))), 6) AS mean FROM (SELECT event_type, n + {n} AS n, total + {total} AS total FROM ({_CLAMPED}))"""


def _noisy(df):
    return df.select("event_type", F.round("n", 6).alias("n"), F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


_LAPLACE = "(-{1} * sign({0} - 0.5) * ln(1 - 2 * abs({0} - 0.5)))"


@query(_noisy_sql(_LAPLACE.format(_DRAW.format("n"), 2.0), _LAPLACE.format(_DRAW.format("total"), 100.0)))
def dp_release(spark, sf):
    """Noise follows from the seed, so the oracle draws it too."""
    a = D.bounded_aggregates(table(spark, sf, "events"), "value", 0, 50, ["event_type"])
    return _noisy(D.release(a, D.Budget(1.0), 1.0, 0, 50, seed=7))


_GAUSS = "({2!r} * sqrt(-2 * ln({0})) * cos(2 * pi() * {1}))"


@query(_noisy_sql(*(_GAUSS.format(_DRAW.format(k), _DRAW.format(f"{k}2"), D.gaussian_sd(s, 0.5, 5e-6)) for k, s in (("n", 1.0), ("total", 50.0)))))
def dp_release_gaussian(spark, sf):
    a = D.bounded_aggregates(table(spark, sf, "events"), "value", 0, 50, ["event_type"])
    return _noisy(D.release(a, D.Budget(1.0, 1e-5), 1.0, 0, 50, seed=7, delta=1e-5))


_GOLD = "SELECT l_orderkey AS doc_id, l_linenumber * 10 AS s, l_linenumber * 10 + 6 AS e, l_returnflag AS label FROM lineitem"
_PRED = "SELECT l_orderkey AS doc_id, l_linenumber * 10 + l_partkey % 9 AS s, l_linenumber * 10 + l_partkey % 9 + 1 + l_suppkey % 3 AS e, CASE WHEN l_suppkey % 7 = 0 THEN 'N' ELSE l_returnflag END AS label FROM lineitem WHERE l_partkey % 11 > 0"


def _gold_and_pred(spark, sf):
    li, at = table(spark, sf, "lineitem"), F.col("l_linenumber") * 10
    begin = at + F.col("l_partkey") % 9
    gold = li.select(F.col("l_orderkey").alias("doc_id"), at.alias("start"), (at + 6).alias("end"), F.col("l_returnflag").alias("label"))
    pred = li.where("l_partkey % 11 > 0").select(F.col("l_orderkey").alias("doc_id"), begin.alias("start"), (begin + 1 + F.col("l_suppkey") % 3).alias("end"), F.when(F.col("l_suppkey") % 7 == 0, "N").otherwise(F.col("l_returnflag")).alias("label"))
    return gold, pred


_RATES = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"


@query(f"""WITH g AS (SELECT DISTINCT * FROM ({_GOLD})), p AS (SELECT DISTINCT * FROM ({_PRED})),
gh AS (SELECT label, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.label = g.label AND g.s < p.e AND g.e > p.s)) AS gold_hit FROM g GROUP BY label),
ph AS (SELECT label, count(*) AS pred, count(*) FILTER (EXISTS (SELECT 1 FROM g WHERE p.doc_id = g.doc_id AND p.label = g.label AND g.s < p.e AND g.e > p.s)) AS pred_hit FROM p GROUP BY label)
SELECT label, gold, pred, gold_hit, pred_hit, {_RATES} FROM (SELECT *, pred_hit / pred AS p, gold_hit / gold AS r FROM gh JOIN ph USING (label))""")
def span_f1_relaxed(spark, sf):
    return M.relaxed_span_scores(*_gold_and_pred(spark, sf)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH g AS ({_GOLD}), p AS ({_PRED}), x AS (SELECT g.label, sum(least(g.e, p.e) - greatest(g.s, p.s)) AS shared FROM g JOIN p ON p.doc_id = g.doc_id AND p.label = g.label AND g.s < p.e AND g.e > p.s GROUP BY g.label)
SELECT label, gold, pred, shared, {_RATES} FROM (SELECT *, shared / pred AS p, shared / gold AS r FROM (SELECT label, sum(e - s)::BIGINT AS gold FROM g GROUP BY label) JOIN (SELECT label, sum(e - s)::BIGINT AS pred FROM p GROUP BY label) USING (label) JOIN (SELECT label, shared::BIGINT AS shared FROM x) USING (label))""")
def span_f1_chars(spark, sf):
    return M.char_scores(*_gold_and_pred(spark, sf)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""WITH s AS (SELECT event_type AS g, count(value) AS n, avg(value) AS m, var_samp(value) / count(value) AS e FROM events GROUP BY 1)
SELECT a.n AS base_n, b.n AS other_n, round(a.m, 6) AS base_mean, round(b.m, 6) AS other_mean, round((b.m - a.m) / sqrt(a.e + b.e), 6) AS t, round((a.e + b.e) ** 2 / (a.e ** 2 / (a.n - 1) + b.e ** 2 / (b.n - 1)), 4) AS df FROM s a, s b WHERE a.g = 'view' AND b.g = 'click'""")
def welch_events(spark, sf):
    """The test's p has no SQL form; unit tests hold it against tabled values."""
    w = M.welch_test(table(spark, sf, "events"), "value", "event_type", "view", "click")
    return w.select("base_n", "other_n", F.round("base_mean", 6).alias("base_mean"), F.round("other_mean", 6).alias("other_mean"), F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query()
def synthetic_table(spark, sf):
    """Synthetic customers; tests hold fidelity and that no source row is copied."""
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))
    m = D.fit_synthesizer(c, ["c_acctbal"], ["c_mktsegment"])
    return D.without_source_rows(D.sample_synthesizer(spark, m, 500, seed=3), c, ["c_acctbal", "c_mktsegment"])


@query()
def lattice_anonymize(spark, sf):
    """The least generalisation of part sizes and keys to k = 25; tests hold it against every node of the lattice."""
    p = table(spark, sf, "part").select((F.col("p_size") % 60).alias("age"), F.lpad((F.col("p_partkey") % 40).cast("string"), 3, "0").alias("zip"))
    released, _ = T.anonymize(p, {"age": "age", "zip": "zip"}, 25)
    return released.groupBy("age", "zip").agg(F.count("*").alias("size"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf):
    return E.tumbling(table(spark, sf, "events"), "1 day", "event_type")


@query("SELECT s AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events) GROUP BY ALL")
def window_sliding(spark, sf):
    return E.sliding(table(spark, sf, "events"), "1 day", "12 hours", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark, sf):
    return E.sessions(table(spark, sf, "events"), "6 hours", "user_id")


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id, event_type")
def stream_dedupe(spark, sf):
    from ..functions.hashing import dedupe_key

    e = table(spark, sf, "events").withColumn("dedupe_key", dedupe_key(F.lit("v1"), "user_id", "event_type"))
    return e.groupBy("dedupe_key").agg(F.min("user_id").alias("user_id"), F.min("event_id").alias("first_event")).drop("dedupe_key")


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) IS NULL AS absent, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").isNull().alias("absent")).agg(F.count("*").alias("n"))


_ENTITIES = "SELECT l_orderkey AS doc_id, l_linenumber AS id, l_returnflag AS label, l_discount AS score, CASE WHEN l_partkey % 5 = 0 THEN 'negated' END AS negation, CASE l_suppkey % 4 WHEN 0 THEN 'family' WHEN 1 THEN 'patient' END AS experiencer FROM lineitem"


def _entities(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score"), F.when(F.col("l_partkey") % 5 == 0, "negated").alias("negation"), F.when(F.col("l_suppkey") % 4 == 0, "family").when(F.col("l_suppkey") % 4 == 1, "patient").alias("experiencer"))


@query(f"SELECT doc_id, id FROM ({_ENTITIES}) WHERE (label = 'R' AND score >= 0.05) OR (label = 'N' AND score >= 0.02)")
def entity_filter(spark, sf):
    return N.keep(_entities(spark, sf), ["R", "N"], 0.02, {"R": 0.05}).select("doc_id", "id")


@query(f"WITH e AS ({_ENTITIES}), g AS (SELECT * FROM e WHERE negation IS NULL AND coalesce(experiencer, 'patient') = 'patient') SELECT DISTINCT h.doc_id, h.id AS head, t.id AS tail FROM g h JOIN g t ON h.doc_id = t.doc_id AND t.id = h.id + 1")
def asserted_relations(spark, sf):
    e = _entities(spark, sf)
    relations = e.select("doc_id", F.col("id").alias("head"), (F.col("id") + 1).alias("tail"))
    return N.asserted_relations(relations.distinct(), e).select("doc_id", "head", "tail")


@query("SELECT o_custkey, o_orderkey, rank, n_candidates FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n_candidates FROM orders) WHERE rank <= 3")
def candidate_truncation(spark, sf):
    return N.top_candidates(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank", "n_candidates")


@query("SELECT o_orderkey FROM orders ORDER BY sha256('5' || chr(31) || o_orderkey::VARCHAR) LIMIT 100")
def row_sample(spark, sf):
    return N.sample_rows(table(spark, sf, "orders"), ["o_orderkey"], 100, 5).select("o_orderkey")


@query("""WITH vs AS (SELECT DISTINCT p_brand AS system, p_size AS code, p_size % 10 = 0 AS exclude FROM part WHERE p_size % 4 = 0 OR p_size % 10 = 0), lone AS (SELECT min(p_brand) AS system FROM part)
SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM vs WHERE exclude AND system = p_brand AND code = p_size) AND (p_brand = (SELECT system FROM lone) OR EXISTS (SELECT 1 FROM vs WHERE NOT exclude AND system = p_brand AND code = p_size))""")
def value_set_members(spark, sf):
    p = table(spark, sf, "part")
    listed = p.where("p_size % 4 = 0 OR p_size % 10 = 0").select(F.col("p_brand").alias("system"), F.col("p_size").alias("code"), (F.col("p_size") % 10 == 0).alias("exclude"))
    whole = p.agg(F.min("p_brand").alias("system")).select("system", F.lit(None).cast("int").alias("code"), F.lit(False).alias("exclude"))
    return N.members(p, listed.unionByName(whole), "p_brand", "p_size").select("p_partkey")


_W = lambda d, ws: "(" + " + ".join(f"substr({d}, {i + 1}, 1)::INT * {w}" for i, w in enumerate(ws)) + ")"
_DOWN, _DOWN11 = list(range(10, 1, -1)), list(range(11, 1, -1))
_ID_SQL = f"""SELECT id, (11 - {_W("d", _DOWN)} % 11) % 11 = substr(d, 10, 1)::INT AND (11 - {_W("d", _DOWN)} % 11) % 11 <> 10 AS nhs,
(10 - {_W("e", [1, 3, 7, 9, 1, 3, 7, 9, 1, 3])} % 10) % 10 = id % 10 AS pesel, {_W("d", [9, 8, 7, 6, 5, 4, 3, 2, -1])} % 11 = 0 AND {_W("d", [9, 8, 7, 6, 5, 4, 3, 2, -1])} > 0 AS bsn,
substr('{V.DNI_LETTERS}', substr(d, 1, 8)::INT % 23 + 1, 1) = chr(65 + (id % 26)::INT) AS dni, 97 - ('1' || d || '12')::BIGINT % 97 = id % 97 + 1 AS nir, {_W("d", [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0 AS tfn,
10 * {_W("e", _DOWN)} % 11 % 10 = substr(d, 10, 1)::INT AND 10 * {_W("e", _DOWN11)} % 11 % 10 = id % 10 AND length(replace(e, substr(d, 1, 1), '')) > 0 AS cpf
FROM (SELECT id, d, d || id % 10 AS e FROM (SELECT id, lpad((id * 7919 % 10000000000)::VARCHAR, 10, '0') AS d FROM {_LINES}))"""


@query(_ID_SQL)
def national_ids(spark, sf):
    i = F.col("id")
    rows = _lines(spark, sf).select("id", F.lpad((i * 7919 % 10000000000).cast("string"), 10, "0").alias("d"))
    eleven = F.concat("d", (i % 10).cast("string"))
    return rows.select("id", V.nhs("d").alias("nhs"), V.pesel(eleven).alias("pesel"), V.bsn(F.substring("d", 1, 9)).alias("bsn"), V.dni(F.concat(F.substring("d", 1, 8), F.char((i % 26 + 65).cast("long")))).alias("dni"), V.nir(F.concat(F.lit("1"), "d", F.lit("12"), F.lpad((i % 97 + 1).cast("string"), 2, "0"))).alias("nir"), V.tfn(F.substring("d", 1, 9)).alias("tfn"), V.cpf(eleven).alias("cpf"))
