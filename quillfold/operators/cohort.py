"""Cohorts: a phenotype expression compiled to one plan over person and event tables.

Criteria are judged together: one aggregation by person counts each criterion's occurrences, and the expression is a
boolean of those counts, so and/or/not cost no set operations. Persons without events come in from the person table,
because a negation is taken within all persons. Temporal criteria first reduce their events by a semi join with their
anchor's. Concept sets expand through a hierarchy before anything is scanned.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
#: Defaults of the assertion axes, and terms that say a mention is absent.
DEFAULTS = {"negation": "affirmed", "temporality": "recent", "certainty": "certain", "experiencer": "patient"}
ABSENT = ("N", "NO", "FALSE", "0")


@dataclass(frozen=True)
class ConceptSet:
    id: str
    concept_ids: tuple[int, ...]
    include_descendants: bool = False
    vocabulary: str | None = None


@dataclass(frozen=True)
class Criterion:
    """Events of a concept set, at least ``minimum`` and at most ``maximum``, within dates or around an anchor's events."""

    id: str
    concept_set: str
    minimum: int = 1
    maximum: int | None = None
    start_date: str | None = None
    end_date: str | None = None
    anchor: str | None = None
    days_before: int = 0
    days_after: int = 0
    assertion: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Node:
    operator: str
    children: tuple


@dataclass(frozen=True)
class Phenotype:
    id: str
    concept_sets: tuple[ConceptSet, ...]
    expression: Criterion | Node

    def digest(self) -> str:
        """Identity of the definition: SHA-256 of its canonical JSON."""
        return sha256(json.dumps(self, default=lambda o: o.__dict__, sort_keys=True).encode()).hexdigest()


def _only(d: dict, allowed: set[str]) -> None:
    if unknown := set(d) - allowed:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")


def _criterion(d: dict) -> Criterion:
    _only(d, {"id", "concept_set", "occurrence", "assertion", "temporal"})
    occurrence, temporal = d.get("occurrence", {}), d.get("temporal", {})
    _only(occurrence, {"minimum", "maximum"})
    _only(temporal, {"start_date", "end_date", "anchor_criterion", "days_before", "days_after"})
    c = Criterion(d["id"], d["concept_set"], occurrence.get("minimum", 1), occurrence.get("maximum"), temporal.get("start_date"), temporal.get("end_date"), temporal.get("anchor_criterion"), temporal.get("days_before", 0), temporal.get("days_after", 0), d.get("assertion", {}))
    _only(c.assertion, set(DEFAULTS))
    if not ID.fullmatch(c.id) or c.minimum < 1 or (c.maximum is not None and c.maximum < c.minimum):
        raise ValueError("a criterion needs a plain id and occurrence bounds from 1 on, in order")
    if min(c.days_before, c.days_after) < 0 or (c.anchor is None and (c.days_before or c.days_after)):
        raise ValueError("days around an anchor need an anchor and must not be negative")
    return c


def parse(document: dict | str) -> Phenotype:
    """Read and check a phenotype; fields that aren't known are refused."""
    d = json.loads(document) if isinstance(document, str) else document
    _only(d, {"id", "name", "concept_sets", "expression"})

    def node(x: dict) -> Criterion | Node:
        if "criterion" in x:
            _only(x, {"criterion"})
            return _criterion(x["criterion"])
        _only(x, {"operator", "children"})
        children = tuple(node(c) for c in x["children"])
        if x["operator"] not in ("and", "or", "not") or (len(children) != 1 if x["operator"] == "not" else len(children) < 2):
            raise ValueError("not takes one child, and/or take two or more")
        return Node(x["operator"], children)

    sets = []
    for s in d["concept_sets"]:
        _only(s, {"id", "vocabulary", "concept_ids", "include_descendants"})
        sets.append(ConceptSet(s["id"], tuple(sorted(set(s["concept_ids"]))), bool(s.get("include_descendants")), s.get("vocabulary")))
    out = Phenotype(d["id"], tuple(sets), node(d["expression"]))
    known = {s.id for s in sets}
    ids = [c.id for c in criteria(out.expression)]
    if len(set(ids)) != len(ids) or any(c.concept_set not in known for c in criteria(out.expression)):
        raise ValueError("criterion ids must differ, and their concept sets exist")
    ordered(criteria(out.expression))
    return out


def criteria(e: Criterion | Node) -> list[Criterion]:
    return [e] if isinstance(e, Criterion) else [c for x in e.children for c in criteria(x)]


def ordered(cs: list[Criterion]) -> list[Criterion]:
    """Anchors before what they anchor; a cycle is refused."""
    by, out, state = {c.id: c for c in cs}, [], {}

    def visit(c: Criterion) -> None:
        if state.get(c.id) == 1:
            raise ValueError("anchors form a cycle")
        if c.id in state:
            return
        state[c.id] = 1
        if c.anchor:
            if c.anchor not in by:
                raise ValueError("an anchor is not a criterion")
            visit(by[c.anchor])
        state[c.id] = 2
        out.append(c)

    for c in cs:
        visit(c)
    return out


def descendants(edges: DataFrame, roots: list[int], ancestor: str = "ancestor_concept_id", descendant: str = "descendant_concept_id") -> list[int]:
    """Roots and all below them, however deep; the frontier of a concept set is walked on the driver, a level at a time.

    Each level adds concepts not seen before, so cycles end the walk too.
    """
    seen, frontier = set(roots), set(roots)
    while frontier:
        found = edges.where(F.col(ancestor).isin(*frontier)).select(descendant).distinct().collect()  # one concept set's children
        frontier = {r[0] for r in found} - seen
        seen |= frontier
    return sorted(seen)


def transitive_closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """All (ancestor, descendant) pairs of a DAG with each node's own, by a recursive query."""
    e = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct()
    e.createOrReplaceTempView("_closure_edges")
    nodes = "SELECT p AS n FROM _closure_edges UNION SELECT c FROM _closure_edges"
    return e.sparkSession.sql(f"""WITH RECURSIVE r(ancestor, descendant) AS (
      SELECT n, n FROM ({nodes}) UNION ALL SELECT r.ancestor, e.c FROM r JOIN _closure_edges e ON r.descendant = e.p)
      SELECT DISTINCT ancestor, descendant FROM r""")


def asserted(events: DataFrame, modifiers: str = "term_modifiers", term_exists: str = "term_exists") -> DataFrame:
    """term_present and the four assertion axes of note events; bad JSON and missing axes take the defaults."""
    out = events.withColumn("term_present", ~F.upper(F.trim(F.coalesce(term_exists, F.lit("Y")))).isin(*ABSENT))
    for axis, default in DEFAULTS.items():
        out = out.withColumn(axis, F.coalesce(F.get_json_object(modifiers, f"$.{axis}"), F.lit(default)))
    return out


def _matches(c: Criterion, concepts: list[int], columns: list[str]) -> Column:
    rule = F.col("concept_id").isin(*concepts)
    day = F.col("event_date").try_cast("date")
    if c.start_date:
        rule &= day >= F.lit(c.start_date).cast("date")
    if c.end_date:
        rule &= day <= F.lit(c.end_date).cast("date")
    negation = set(c.assertion.get("negation", ()))
    if "term_present" in columns and negation != {"negated", "affirmed"}:
        rule &= ~F.col("term_present") if negation == {"negated"} else F.col("term_present")
    for axis, values in c.assertion.items():
        if axis in columns:
            rule &= F.col(axis).isin(*values)
    return rule


def matched_events(p: Phenotype, events: DataFrame, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each criterion's events, after dates, assertions and its anchor."""
    sets = {s.id: descendants(edges, list(s.concept_ids)) if s.include_descendants and edges is not None else list(s.concept_ids) for s in p.concept_sets}
    out: dict[str, DataFrame] = {}
    for c in ordered(criteria(p.expression)):
        rows = events.where(_matches(c, sets[c.concept_set], events.columns))
        if c.anchor:
            a = out[c.anchor].select(F.col("person_id").alias("_p"), F.col("event_date").try_cast("date").alias("_d"))
            gap = F.date_diff(F.col("event_date").try_cast("date"), F.col("_d"))
            rows = rows.join(a, (F.col("person_id") == F.col("_p")) & (gap >= -c.days_before) & (gap <= c.days_after), "left_semi")
        out[c.id] = rows
    return out


def resolve(p: Phenotype, persons: DataFrame, events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """person_id of the persons who satisfy the phenotype.

    ``events`` has person_id, concept_id, event_date, and may have term_present and the assertion axes.
    """
    found, tagged = matched_events(p, events, edges), None
    for name, rows in found.items():
        one = rows.select("person_id", F.lit(name).alias("criterion"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.groupBy("person_id").agg(*(F.count_if(F.col("criterion") == name).alias(f"n_{name}") for name in found))
    everyone = persons.select("person_id").distinct().join(counts, "person_id", "left")

    def holds(e: Criterion | Node) -> Column:
        if isinstance(e, Criterion):
            n = F.coalesce(f"n_{e.id}", F.lit(0))
            return (n >= e.minimum) & ((n <= e.maximum) if e.maximum is not None else F.lit(True))
        parts = [holds(c) for c in e.children]
        if e.operator == "not":
            return ~parts[0]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if e.operator == "and" else out | x
        return out

    return everyone.where(holds(p.expression)).select("person_id")


def evidence(p: Phenotype, persons: DataFrame, events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """criterion and event columns of the matched events of resolved persons."""
    chosen, out = resolve(p, persons, events, edges), None
    for name, rows in matched_events(p, events, edges).items():
        one = rows.select(F.lit(name).alias("criterion"), *rows.columns)
        out = one if out is None else out.unionByName(one)
    return out.join(chosen, "person_id", "left_semi")


def provenance(found: DataFrame) -> DataFrame:
    """For each criterion and concept: persons and distinct occurrences; counts only."""
    return found.groupBy("criterion", "concept_id").agg(F.count_distinct("person_id").alias("persons"), F.count_distinct("person_id", "event_date").alias("occurrences"))


def union_domains(domains: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Event tables (frame, person, concept, date columns) as one relation with their domain's name."""
    out = None
    for name, (df, person, concept, date) in domains.items():
        one = df.select(F.lit(name).alias("domain"), F.col(person).alias("person_id"), F.col(concept).alias("concept_id"), F.col(date).cast("string").alias("event_date"))
        out = one if out is None else out.unionByName(one)
    return out
