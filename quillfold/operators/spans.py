"""Spans over documents: detection, arbitration, policy, redaction.

A span is a row (doc_id, start, end, label, surface, score, detector, ...) with half-open code-point offsets. Offsets come
from lengths of the pieces between matches, never from regular-expression positions, which count UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.hashing import date_shift_days
from ..functions.places import occurrences
from ..functions.surrogates import surrogate
from ..scratch import quoted, unused

#: Patterns that mean the same to Java and RE2. Group 1 is what stands before, group 2 the surface.
PATTERNS = {
    "EMAIL": r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})",
    "PHONE": r"(^|[^0-9A-Za-z])([(]?[2-9][0-9]{2}[)]?[-. ][2-9][0-9]{2}[-. ][0-9]{4})",
    "SSN": r"(^|[^0-9A-Za-z])([0-9]{3}-[0-9]{2}-[0-9]{4})",
    "IPV4": r"(^|[^0-9A-Za-z.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})",
    "CARD": r"(^|[^0-9A-Za-z])([0-9]{16})",
    "URL": r"()(https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9._~/?#=&%+-]*)?)",
    "DATE": r"(^|[^0-9A-Za-z])([0-9]{4}-[0-9]{2}-[0-9]{2})",
    "MAC": r"(^|[^0-9A-Za-z:])([0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5})",
    "MRN": r"(^|[^0-9A-Za-z])(MRN[: #]*[0-9]{6,10})",
    "ZIP": r"(^|[^0-9A-Za-z])([0-9]{5}-[0-9]{4})",
}
VALIDATORS: dict[str, Callable[[Column], Column]] = {"SSN": V.ssn, "IPV4": V.ipv4, "CARD": V.card, "PHONE": V.us_phone}
BASE_SCORE = {"EMAIL": 0.95, "PHONE": 0.7, "SSN": 0.8, "IPV4": 0.85, "CARD": 0.75, "URL": 0.9, "DATE": 0.6, "MAC": 0.9, "MRN": 0.85, "ZIP": 0.6}
#: Label, risk rank (high first), default action.
POLICY = [("SSN", 5, "remove"), ("CARD", 5, "hash"), ("MRN", 4, "hash"), ("EMAIL", 4, "mask"), ("PHONE", 3, "mask"), ("IPV4", 2, "mask"), ("MAC", 2, "mask"), ("URL", 1, "keep"), ("DATE", 1, "shift"), ("ZIP", 1, "mask")]
CONTEXT = {"CARD": "card|visa|credit", "PHONE": "phone|tel|call|fax", "SSN": "ssn|social", "IPV4": "ip|host|server", "EMAIL": "mail|contact", "MRN": "record|patient", "DATE": "born|birth|dob|date"}
WINDOW, BOOST = 40, 0.1


#: What stands in every text that the pattern matches: a literal, or a simpler expression.
PROBES = {
    "EMAIL": ("contains", "@"),
    "URL": ("contains", "://"),
    "MRN": ("contains", "MRN"),
    "PHONE": ("rlike", "[2-9][0-9]{2}[-. ][0-9]{4}"),
    "SSN": ("rlike", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "IPV4": ("rlike", "[0-9][.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]"),
    "CARD": ("rlike", "[0-9]{16}"),
    "DATE": ("rlike", "[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    "MAC": ("rlike", "(?::[0-9A-Fa-f]{2}){5}"),
    "ZIP": ("rlike", "[0-9]{5}-[0-9]{4}"),
}


def register(label: str, pattern: str, validator: Callable[[Column], Column] | None = None, score: float = 0.5, probe: tuple[str, str] | None = None, context: str | None = None) -> None:
    """Add a detector: a pattern whose group 1 is what stands before and whose group 2, the surface, ends the match, and
    perhaps a check of surfaces, something that stands in every text it matches, and words that raise the score."""
    PATTERNS[label], BASE_SCORE[label] = pattern, score
    for table, value in ((VALIDATORS, validator), (PROBES, probe), (CONTEXT, context)):
        table.pop(label, None)
        if value is not None:
            table[label] = value


def national(countries: list[str] | None = None) -> list[str]:
    """Register the national identifiers of the countries (all, if None); their labels, for ``labels``."""
    chosen = {k: v for k, v in V.NATIONAL.items() if countries is None or v[0] in countries}
    for label, (_, pattern, check) in chosen.items():
        register(label, pattern, check, 0.8)
    return sorted(chosen)


SPAN = "struct<start:int,end:int,label:string,surface:string,score:double,valid:boolean,detector:string>"


def _text(text: Column | str) -> Column:
    return quoted(text) if isinstance(text, str) else text


def may_hold(text: Column, label: str, patterns: dict[str, str] = PATTERNS) -> Column:
    """Whether the label's pattern is worth trying: false only where it cannot match."""
    if label not in PROBES or patterns.get(label) != PATTERNS.get(label):
        return text.isNotNull()
    kind, sought = PROBES[label]
    return getattr(text, kind)(sought)


def matches(text: Column | str, label: str, patterns: dict[str, str] = PATTERNS, group: int = 2) -> Column:
    """All matches of a label in a text, in order; null where there cannot be any."""
    t = _text(text)
    return F.when(may_hold(t, label, patterns), F.regexp_extract_all(t, F.lit(patterns[label]), F.lit(group)))


def surfaces(text: Column | str, label: str, patterns: dict[str, str] = PATTERNS) -> Column:
    """All surfaces of a label in a text, in order; null where there cannot be any."""
    return matches(text, label, patterns, 2)


def with_spans(docs: DataFrame, out: str = "spans", labels: list[str] | None = None, text_col: str = "text", patterns: dict[str, str] = PATTERNS, validate: bool = True) -> DataFrame:
    """The same rows with an array of their spans: every match of every pattern, by start and end.

    All labels are found in one scan of the text, and nothing is joined or shuffled: rows need no key. A pattern whose
    surface ends its match is located by code points. The score is the label's base, raised when one of its context words
    stands within ``WINDOW`` characters. A null text has no spans.
    """
    labels = labels or sorted(patterns)
    held = unused(docs, *(f"_matches_{x}" for x in labels))
    text = _text(text_col)
    found = docs.select("*", *(matches(text, x, patterns, 0).alias(h) for x, h in zip(labels, held)))

    def spans_of(label: str, whole: Column) -> Column:
        def span(m: Column) -> Column:
            ok = VALIDATORS[label](m["surface"]) if validate and label in VALIDATORS else F.lit(True)
            around = F.lower(F.substring(text, F.greatest(m["start"] - WINDOW + 1, F.lit(1)), m["end"] - m["start"] + 2 * WINDOW))
            boost = F.when(around.rlike(CONTEXT[label]), BOOST).otherwise(0.0) if label in CONTEXT else F.lit(0.0)
            score = F.least(F.lit(1.0), F.lit(BASE_SCORE.get(label, 0.5)) + boost)
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label"), m["surface"].alias("surface"), score.alias("score"), F.coalesce(ok, F.lit(False)).alias("valid"), F.lit(f"rules:{label.lower()}").alias("detector"))

        return F.when(F.size(whole) > 0, F.transform(occurrences(text, patterns[label], 2, whole), span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    every = F.concat(*(spans_of(x, quoted(h)) for x, h in zip(labels, held)))
    return found.select(*(quoted(c) for c in docs.columns if c.lower() != out.lower()), F.array_sort(every).alias(out))


def detect(docs: DataFrame, labels: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", patterns: dict[str, str] = PATTERNS, validate: bool = True) -> DataFrame:
    """doc_id, start, end, label, surface, score, valid, detector: a row for each span of ``with_spans``."""
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "spans", labels, "text", patterns, validate)
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def match_counts(docs: DataFrame, labels: list[str], *keys: str, text_col: str = "text") -> DataFrame:
    """n of matches for all combinations of the keys and label, with totals; one scan, matches are counted within rows."""
    each = F.array(*(F.struct(F.lit(x).alias("label"), F.size(F.coalesce(matches(text_col, x, group=0), F.array().cast("array<string>"))).alias("n")) for x in labels))
    rows = docs.select(*keys, F.explode(F.filter(each, lambda c: c["n"] > 0)).alias("c")).select(*keys, "c.label", "c.n")
    return rows.cube(*keys, "label").agg(F.sum("n").alias("n"))


def _better(x: Column, y: Column, policy: list[tuple]) -> Column:
    """Whether x wins over y: rules first, then specificity, length, score, earlier start, detector."""
    key = lambda s: F.struct(F.when(s["detector"].startswith("rules:"), 0).otherwise(1), -specificity(policy, s["label"]), s["start"] - s["end"], -s["score"], s["start"])
    return (key(x) < key(y)) | ((key(x) == key(y)) & (x["detector"] > y["detector"]))


def winners(spans: Column | str, floor: float = 0.0, policy: list[tuple] = POLICY, kind: str = SPAN) -> Column:
    """The winner of each overlap cluster of an array of spans, in order: ``arbitrate_balanced`` within the row.

    ``kind`` is the type of a span, whose first fields are start and end.
    """
    s = F.col(spans) if isinstance(spans, str) else spans
    ordered = F.array_sort(F.filter(s, lambda x: x["score"] >= floor))
    none = F.lit(None).cast(kind)
    state = F.struct(F.lit(-1).alias("reach"), none.alias("best"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens = x["start"] >= acc["reach"]
        best = F.when(opens | _better(x, acc["best"], policy), x).otherwise(acc["best"])
        done = F.when(opens & acc["best"].isNotNull(), F.concat(acc["out"], F.array(acc["best"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["reach"], x["end"]).alias("reach"), best.alias("best"), done.alias("out"))

    last = lambda acc: F.when(acc["best"].isNotNull(), F.concat(acc["out"], F.array(acc["best"]))).otherwise(acc["out"])
    return F.when(F.size(ordered) > 1, F.aggregate(ordered, state, step, last)).otherwise(ordered)


def with_clusters(spans: DataFrame) -> DataFrame:
    """cluster: spans of a document that overlap, directly or in a chain, share one. Touching spans do not overlap."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def specificity(policy: list[tuple] = POLICY, label: Column | str = "label") -> Column:
    pairs = [F.lit(x) for name, rank, _ in policy for x in (name, rank)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(label) if isinstance(label, str) else label), F.lit(0))


def arbitrate_balanced(spans: DataFrame, floor: float = 0.0) -> DataFrame:
    """The winner of each overlap cluster: rules first, then specificity, length, score, earlier start, detector."""
    kept = spans.where(F.col("score") >= floor)
    order = Window.partitionBy("doc_id", "cluster").orderBy(F.col("detector").startswith("rules:").desc(), specificity().desc(), (F.col("end") - F.col("start")).desc(), F.col("score").desc(), F.col("start"), F.col("detector").desc())
    return with_clusters(kept).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "cluster")


def arbitrate_union(spans: DataFrame, floor: float = 0.0) -> DataFrame:
    """High recall: all spans above the floor, of exact duplicates the best."""
    order = Window.partitionBy("doc_id", "start", "end", "label").orderBy(F.col("score").desc(), "detector")
    return spans.where(F.col("score") >= floor).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Greedy by risk, length, score, start, end: a span stays if it overlaps none that stays before it.

    The order matters, so overlap clusters of several spans are folded one by one; the others need no fold.
    """
    rank = F.struct((-specificity()).alias("a"), (F.col("start") - F.col("end")).alias("b"), (-F.col("score")).alias("c"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("label").alias("label"), F.col("detector").alias("detector"))
    groups = with_clusters(spans).groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(rank)).alias("spans"))
    kind = "array<struct<a:int,b:int,c:double,start:int,end:int,label:string,detector:string>>"
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
    kept = F.aggregate("spans", F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return groups.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.end", "s.label", (-F.col("s.c")).alias("score"), "s.detector")


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id and both spans of each overlapping pair; an equi-join on the document with the range as residual."""
    a = left.select("doc_id", F.struct("start", "end", "label").alias("a"))
    b = right.select("doc_id", F.struct("start", "end", "label").alias("b"))
    return a.join(b, "doc_id").where("a.start < b.end AND a.end > b.start")


def suppress_allowed(spans: DataFrame, allowed: DataFrame) -> DataFrame:
    """Spans that overlap no allowed span."""
    a = allowed.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(a, (spans["doc_id"] == a["_d"]) & (spans["start"] < a["_e"]) & (spans["end"] > a["_s"]), "left_anti")


def protect_terms(spans: DataFrame, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Spans whose folded surface is no protected term."""
    t = terms.select(F.lower(F.trim(term_col)).alias("_t")).distinct()
    return spans.join(t, F.lower(F.trim("surface")) == t["_t"], "left_anti")


def above_threshold(spans: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    """Spans at or above the floor of their label and language; ``thresholds`` is (label, lang, floor)."""
    out = spans.join(thresholds, ["label", "lang"], "left")
    return out.where(F.col("score") >= F.coalesce("floor", F.lit(default))).drop("floor")


def apply_policy(spans: DataFrame, policy: list[tuple] = POLICY, default: str = "mask") -> DataFrame:
    """action for each span: its label's, else the default."""
    table = spans.sparkSession.createDataFrame([(n, a) for n, _, a in policy], "label string, action string")  # a row for each label
    return spans.join(F.broadcast(table), "label", "left").withColumn("action", F.coalesce("action", F.lit(default)))


def action_of(label: Column, policy: list[tuple] = POLICY, default: str = "mask") -> Column:
    """A label's action, else the default."""
    table = [F.lit(x) for name, _, action in policy for x in (name, action)]
    return F.coalesce(F.try_element_at(F.create_map(*table), label), F.lit(default)) if table else F.lit(default)


def replacement(key_digits: int = 8, label: Column | str = "label", surface: Column | str = "surface", action: Column | str = "action", secret: bytes | None = None, subject: Column | None = None, lang: Column | None = None, days: Column | None = None) -> Column:
    """What a span becomes, by its action.

    mask: [LABEL]; remove: nothing; hash: LABEL_digest; keep: itself; replace: a surrogate of the same kind, the same for
    equal surfaces of a subject; shift: a date moved by so many days. Replace masks without a ``secret``, shift without
    ``days`` or where a surface is no date.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    label, surface, action = c(label), c(surface), c(action)
    mask = F.concat(F.lit("["), label, F.lit("]"))
    digest = F.concat(label, F.lit("_"), F.substring(F.sha2(surface.cast("binary"), 256), 1, key_digits))
    out = F.when(action == "remove", "").when(action == "hash", digest).when(action == "keep", surface)
    if secret is not None:
        who = F.lit("") if subject is None else F.coalesce(subject.cast("string"), F.lit(""))
        out = out.when(action == "replace", F.coalesce(surrogate(label, surface, secret, who, lang), mask))
    if days is not None:
        day = F.call_function("try_to_date", surface, F.lit("yyyy-MM-dd"))
        out = out.when(action == "shift", F.coalesce(F.date_format(F.date_add(day, days), "yyyy-MM-dd"), mask))
    return out.otherwise(mask)


def numbered_masks(spans: DataFrame) -> DataFrame:
    """mask: [LABEL], and [LABEL_2], ... for further surfaces of a label in order of their first place in the document."""
    first = F.min("start").over(Window.partitionBy("doc_id", "label", "surface"))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "label").orderBy("_first", "surface"))
    out = spans.withColumn("_first", first).withColumn("_n", n)
    return out.withColumn("mask", F.concat(F.lit("["), "label", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit("]"))).drop("_first", "_n")


def splice(text: Column, spans: Column) -> Column:
    """The text with (start, end, replacement) applied; spans that begin before the last one ended are left out."""
    state = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"])
        rest = F.substring(acc["rest"], s["end"] - acc["at"] + 1, F.lit(2**31 - 1))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), rest.alias("rest"), F.concat(acc["out"], F.array(before, s["replacement"])).alias("out"))).otherwise(acc)

    whole = F.aggregate(F.array_sort(spans), state, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(acc["rest"])), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with spans of another table (with surface and action) replaced, and how many were.

    Spans meet documents by id, a null id those without one. A span that does not lie in the text where it says, as where
    rows with other texts share the id, is not applied there. Documents without spans keep their text. ``options`` are
    those of ``replacement``. For pattern spans ``deidentify`` needs neither ids nor a join.
    """
    key, edits = unused(docs, "_id", "_edits")
    e = F.struct("start", "end", replacement(**options).alias("replacement"), "surface")
    mine = spans.select(F.col("doc_id").alias(key), e.alias(edits)).groupBy(key).agg(F.collect_list(edits).alias(edits))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string,surface:string>>")
    text = _text(text_col)
    out = docs.join(mine, docs[id_col].eqNullSafe(mine[key]), "left")
    fits = F.filter(F.coalesce(F.col(edits), none), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["surface"])
    return out.withColumn(edits, fits).withColumn("redacted", splice(text, F.col(edits))).withColumn("n_spans", F.size(edits)).drop(key, edits)


def deidentify(docs: DataFrame, labels: list[str] | None = None, policy: list[tuple] = POLICY, floor: float = 0.0, text_col: str = "text", method: str | None = None, secret: bytes | None = None, subject_col: str | None = None, lang_col: str | None = None, max_days: int = 365, patterns: dict[str, str] = PATTERNS, more: Column | None = None) -> DataFrame:
    """The same rows with redacted and n_spans: detect, keep the valid, arbitrate, decide, replace.

    All of it happens within the row, in the JVM: no key, no join, no shuffle, so null and repeated ids are safe.
    ``method`` is an action for all labels in place of the policy's. ``secret`` keys surrogates and date offsets, the
    latter by ``subject_col``. ``more`` is an array of spans (``SPAN``) of another detector. Columns redacted and n_spans
    are replaced; a null text stays null.
    """
    if method is not None and method not in ("mask", "remove", "hash", "keep", "replace", "shift"):
        raise ValueError(f"unknown method: {method}")
    rows = docs.drop(*(c for c in docs.columns if c.lower() in ("redacted", "n_spans")))
    held, won, days = unused(rows, "_spans", "_won", "_days")
    col = lambda c: None if c is None else quoted(c)
    may = {method} if method else {a for n, _, a in policy if not labels or n in labels}
    shifts = secret is not None and subject_col is not None and "shift" in may
    found = with_spans(rows, held, labels, text_col, patterns)
    found = found.withColumn(days, date_shift_days(secret, col(subject_col), max_days) if shifts else F.lit(None).cast("int"))
    valid = F.filter(held, lambda s: s["valid"])
    if more is not None:
        valid = F.concat(valid, F.coalesce(more, F.array().cast(f"array<{SPAN}>")))
    found = found.withColumn(won, winners(valid, floor, policy))
    act = lambda s: F.lit(method) if method else action_of(s["label"], policy)
    keyed = secret if "replace" in may else None
    new = lambda s: replacement(8, s["label"], s["surface"], act(s), keyed, col(subject_col), col(lang_col), F.col(days) if shifts else None)
    edits = F.transform(won, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), new(s).alias("replacement")))
    out = found.withColumn(held, edits)
    return out.select(*(quoted(c) for c in rows.columns), splice(_text(text_col), F.col(held)).alias("redacted"), F.size(held).alias("n_spans"))


def mask_by_patterns(text: Column | str, labels: list[str], style: str = "mask") -> Column:
    """One pass of replacements for each label, in order, with no Python and no shuffle: the fast path of masking.

    ``style`` is mask ([LABEL]) or remove. What stood before the surface is kept.
    """
    out = F.col(text) if isinstance(text, str) else text
    for label in labels:
        new = F.regexp_replace(out, F.lit(PATTERNS[label]), F.lit("$1" + ("" if style == "remove" else f"[{label}]")))
        out = F.when(may_hold(out, label), new).otherwise(out)
    return out


def sweep(docs: DataFrame, existing: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Safety sweep: valid pattern spans that overlap nothing found before, ordered by score, then start, then length."""
    fresh = suppress_allowed(detect(docs, labels).where("valid"), existing)
    return resolve_overlaps(fresh)


def reidentify(redacted: DataFrame, mapping: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Texts with the placeholders of ``mapping`` (doc_id, placeholder, surface) put back, longest first."""
    pairs = mapping.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct((-F.char_length("placeholder")).alias("n"), "placeholder", "surface"))).alias("_m"))
    out = redacted.join(pairs, redacted[id_col] == pairs["_id"], "left")
    restored = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<n:int,placeholder:string,surface:string>>")), F.col("redacted"), lambda t, m: F.replace(t, m["placeholder"], m["surface"]))
    return out.withColumn("restored", restored).drop("_m", "_id")


def span_counts(spans: DataFrame, *keys: str) -> DataFrame:
    """Counts by all combinations of the keys, with totals."""
    return spans.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def smart_merge(spans: DataFrame, gap: int = 1) -> DataFrame:
    """Fragments of a document no further apart than ``gap`` become one span; its label is the most frequent, then the one
    with the highest mean score, then the first by name."""
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).withColumn("unit", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    votes = marked.groupBy("doc_id", "unit", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.avg("score").alias("mean"))
    best = F.min_by("label", F.struct(-F.col("n"), -F.col("mean"), F.col("label")))
    return votes.groupBy("doc_id", "unit").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("label"), F.sum("n").alias("fragments")).drop("unit")
