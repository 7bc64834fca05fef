"""Exports: OMOP rows, a flat table, clinical resources as JSON, retrieval chunks, SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import surrogate_key
from ..operators.spans import PATTERNS, mask_by_patterns

FLAT_COLUMNS = ("entity_label", "normalized_text", "system", "code", "display", "negation", "temporality", "certainty", "start", "end", "section")
#: Other names that a flat column may come under.
FLAT_ALIASES = {"entity_label": ("label", "entity_type", "entity_group", "entity"), "normalized_text": ("text", "word"), "system": ("vocabulary_id",), "code": ("concept_code",)}


def flat_table(entities: DataFrame) -> DataFrame:
    """The fixed columns, taken from the first of their names that is there; what is missing is null."""
    cols = []
    for c in FLAT_COLUMNS:
        there = [F.col(x).cast("string") for x in (c, *FLAT_ALIASES.get(c, ())) if x in entities.columns]
        cols.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(c))
    return entities.select(*cols)


def omop_notes(notes: DataFrame, entities: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """person, note, note_nlp and condition_occurrence rows, with keys that depend on their parts alone.

    ``notes`` has document_id, patient_id, text, note_date; ``entities`` document_id, start, end, text, code,
    vocabulary_id, negation; ``concepts`` concept_id, vocabulary_id, concept_code, standard_id. An unmapped code gets
    concept 0.
    """
    person = surrogate_key(F.lit("person"), "patient_id")
    note = surrogate_key(F.lit("note"), "document_id")
    n = notes.select("*", person.alias("person_id"), note.alias("note_id"))
    persons = n.select("person_id").distinct()
    maps = concepts.select("vocabulary_id", F.col("concept_code").alias("code"), F.coalesce("standard_id", "concept_id").alias("concept_id"), F.col("concept_id").alias("source_concept_id"))
    e = entities.join(n.select("document_id", "person_id", "note_id", "note_date"), "document_id").join(maps, ["vocabulary_id", "code"], "left")
    e = e.withColumn("note_nlp_id", surrogate_key(F.lit("nlp"), "document_id", F.col("start"), F.col("end"), "code"))
    nlp = e.select("note_nlp_id", "note_id", F.col("start").alias("offset"), F.col("end").alias("offset_end"), F.col("text").alias("lexical_variant"), F.coalesce("concept_id", F.lit(0)).alias("note_nlp_concept_id"), F.when(F.col("negation") == "negated", "N").otherwise("Y").alias("term_exists"))
    asserted = e.where("negation IS NULL OR negation <> 'negated'")
    cond = asserted.select(surrogate_key(F.lit("condition"), "note_nlp_id").alias("condition_occurrence_id"), "person_id", F.coalesce("concept_id", F.lit(0)).alias("condition_concept_id"), F.coalesce("source_concept_id", F.lit(0)).alias("condition_source_concept_id"), F.col("note_date").alias("condition_start_date"), "note_id", "note_nlp_id")
    note_rows = n.select("note_id", "person_id", "note_date", F.sha2(F.col("text").cast("binary"), 256).alias("source_note_hash"))
    return {"person": persons, "note": note_rows, "note_nlp": nlp, "condition_occurrence": cond}


def mapping_summary(nlp: DataFrame) -> DataFrame:
    """One row: mapped, unmapped, rate."""
    mapped = F.count_if(F.col("note_nlp_concept_id") != 0)
    return nlp.agg(mapped.alias("mapped"), F.count_if(F.col("note_nlp_concept_id") == 0).alias("unmapped"), (mapped / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def smoke_check(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[str]:
    """What is wrong with an export: missing tables, missing columns, events of unknown persons."""
    wrong = [f"{t} is missing" for t in required if t not in tables]
    wrong += [f"{t}.{c} is missing" for t, cols in required.items() if t in tables for c in cols if c not in tables[t].columns]
    if not wrong and "person" in tables:
        for t, df in tables.items():
            if t != "person" and "person_id" in df.columns and not df.join(tables["person"], "person_id", "left_anti").isEmpty():
                wrong.append(f"{t} has rows of unknown persons")
    return wrong


def conditions_json(cond: DataFrame) -> DataFrame:
    """A condition resource for each row."""
    code = F.struct(F.array(F.struct(F.col("system"), F.col("code"), F.col("display"))).alias("coding"), F.col("normalized_text").alias("text"))
    status = F.struct(F.array(F.struct(F.when(F.col("negation") == "negated", "refuted").otherwise("confirmed").alias("code"))).alias("coding"))
    body = F.struct(F.lit("Condition").alias("resourceType"), F.col("id"), status.alias("verificationStatus"), code.alias("code"), F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject"))
    return cond.select("id", "patient_id", F.to_json(body).alias("resource"))


def bundles(resources: DataFrame, key: str = "patient_id") -> DataFrame:
    """A collection for each key, entries ordered by id."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("id", "resource"))), lambda r: F.concat(F.lit('{"resource":'), r["resource"], F.lit("}")))
    return resources.groupBy(key).agg(F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(entries, ","), F.lit("]}")).alias("bundle"))


def composition_json(entities: DataFrame, key: str, path: str = "encounter/problem_diagnosis") -> DataFrame:
    """A flat composition for each key: indexed paths to codes and texts."""
    row = F.struct("start", "code", "system", "normalized_text")
    g = entities.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("r"))
    pairs = F.flatten(F.transform("r", lambda r, i: F.array(F.struct(F.concat(F.lit(f"{path}:"), i.cast("string"), F.lit("|value")).alias("k"), r["normalized_text"].alias("v")), F.struct(F.concat(F.lit(f"{path}:"), i.cast("string"), F.lit("|code")).alias("k"), r["code"].alias("v")))))
    return g.select(key, F.to_json(F.map_from_entries(pairs)).alias("composition"))


def retrieval_chunks(docs: DataFrame, labels: list[str], size: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk, text: redacted texts in pieces of at most ``size`` words."""
    words = F.split(mask_by_patterns(text_col, labels), " ")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda i: F.array_join(F.slice("w", i * size + 1, size), " "))
    return docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).select("doc_id", F.posexplode(cut).alias("chunk", "text"))


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """question_id, doc_id, chunk, overlap, rank: chunks that share most distinct words with a question."""
    from pyspark.sql import Window

    tokens = lambda df, cols, text: df.select(*cols, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("t")).where("length(t) > 2")
    hits = tokens(questions, ["question_id"], "question").join(tokens(chunks, ["doc_id", "chunk"], "text"), "t").groupBy("question_id", "doc_id", "chunk").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("question_id").orderBy(F.col("overlap").desc(), "doc_id", "chunk")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def register_sql_functions(spark: SparkSession, labels: list[str]) -> None:
    """quillfold_deidentify(text) and quillfold_pii_count(text) as SQL expressions, without Python workers."""
    quote = lambda s: "r'" + s + "'" if "'" not in s else '"' + s.replace("\\", "\\\\") + '"'
    masked, counts = "t", []
    for x in labels:
        masked = f"regexp_replace({masked}, {quote(PATTERNS[x])}, '$1[{x}]')"
        counts.append(f"size(regexp_extract_all(t, {quote(PATTERNS[x])}, 2))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quillfold_deidentify(t STRING) RETURNS STRING RETURN {masked}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quillfold_pii_count(t STRING) RETURNS INT RETURN {' + '.join(counts)}")
