"""Documents as wholes: script and type, windows of sentences, coreference, relation candidates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import sentences

#: Characters of windows after which a batch is handed on.
FLUSH = 8 << 20
#: Scripts by their code point ranges.
SCRIPTS = {"latin": "A-Za-z\\u00C0-\\u024F", "greek": "\\u0370-\\u03FF", "cyrillic": "\\u0400-\\u04FF", "hebrew": "\\u0590-\\u05FF", "arabic": "\\u0600-\\u06FF", "devanagari": "\\u0900-\\u097F", "han": "\\u4E00-\\u9FFF", "kana": "\\u3040-\\u30FF", "hangul": "\\uAC00-\\uD7AF"}
RTL = ("hebrew", "arabic")
#: Phrases that speak for a document type.
TYPES = {"discharge_summary": ("discharge summary", "discharge diagnosis", "hospital course"), "radiology_report": ("impression:", "findings:", "technique:"), "progress_note": ("progress note", "subjective:", "assessment and plan"), "pathology_report": ("gross description", "microscopic description", "specimen")}


def script(text: Column | str, scripts: dict[str, str] = SCRIPTS) -> Column:
    """Of those given, the script with most letters; ties go by name, none is null."""
    t = F.col(text) if isinstance(text, str) else text
    counts = [F.struct(F.char_length(F.regexp_replace(t, f"[^{r}]", "")).alias("n"), F.lit(name).alias("name")) for name, r in sorted(scripts.items(), reverse=True)]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"])


def isolate_mask(mask: Column, direction_of: Column) -> Column:
    """A placeholder in a right-to-left text, wrapped so that its brackets stay in order."""
    return F.when(script(direction_of).isin(*RTL), F.concat(F.lit("⁨"), mask, F.lit("⁩"))).otherwise(mask)


def document_type(text: Column | str, margin: float = 0.34) -> Column:
    """The type whose phrases are found most, as a share; unknown if none, or if the next is within the margin."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    scores = F.array_sort(F.array(*(F.struct((-sum((F.when(low.contains(p), 1.0).otherwise(0.0) for p in ps), F.lit(0.0)) / len(ps)).alias("s"), F.lit(name).alias("name")) for name, ps in TYPES.items())))
    first, second = F.element_at(scores, 1), F.element_at(scores, 2)
    return F.when((first["s"] == 0) | (second["s"] - first["s"] < margin), "unknown").otherwise(first["name"])


def sentence_windows(docs: DataFrame, size: int, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, window, text: whole sentences packed greedily to ``size`` characters; a longer sentence is its own window.

    Each window but the first begins with the last ``overlap`` sentences of the one before. Sentences are cut by Column
    expressions and packed in one pass over each text, so that the work is linear in the number of sentences.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), sentences(text_col).alias("s"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, numbers, texts, held = [], [], [], 0
            for row, found in enumerate(batch.column(1)):
                window, before, number, used = [], [], 0, 0
                for s in [*(found.as_py() or ()), None]:
                    if window and (s is None or used + len(s) > size):
                        at.append(row)
                        numbers.append(number)
                        texts.append(" ".join(before + window))
                        held += len(texts[-1])
                        window, before, number, used = [], window[-overlap:] if overlap else [], number + 1, 0
                    if s is not None:
                        window.append(s)
                        used += len(s) + 1
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "window", "text"])
                    at, numbers, texts, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "window", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, window int, text string")


#: Weights of a coreference pair's score, and the score that links.
COREF = {"string": 0.42, "type": 0.18, "context": 0.14, "distance": 0.10, "code": 0.16}
COREF_LINK = 0.72


def coreference_links(mentions: DataFrame) -> DataFrame:
    """a, b, score of mention pairs of a document that corefer.

    Mentions have doc_id, id, text, type, section, code, start. Different codes never link.
    """
    m = lambda k: mentions.select("doc_id", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "text", "type", "section", "code", "start")))
    p = m("a").join(m("b"), "doc_id").where("id_a < id_b")
    fold = lambda c: F.lower(F.trim(c))
    close = 1 - F.least(F.abs(F.col("start_a") - F.col("start_b")), F.lit(1000)) / 1000
    one = lambda rule, w: F.when(rule, w).otherwise(0.0)
    score = one(fold("text_a") == fold("text_b"), COREF["string"]) + one(F.col("type_a") == F.col("type_b"), COREF["type"]) + one(F.col("section_a").eqNullSafe(F.col("section_b")), COREF["context"]) + COREF["distance"] * close + one(F.col("code_a") == F.col("code_b"), COREF["code"])
    apart = F.coalesce(F.col("code_a") != F.col("code_b"), F.lit(False))
    return p.where(~apart).select("doc_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.round(score, 6).alias("score")).where(F.col("score") >= COREF_LINK)


def relation_candidates(mentions: DataFrame, head: str, tail: str, reach: int) -> DataFrame:
    """Pairs of a head and a tail mention of one document and sentence, no further apart than ``reach`` characters."""
    h = mentions.where(F.col("type") == head).select("doc_id", "sentence", F.col("id").alias("head"), F.col("start").alias("hs"))
    t = mentions.where(F.col("type") == tail).select("doc_id", "sentence", F.col("id").alias("tail"), F.col("start").alias("ts"))
    return h.join(t, ["doc_id", "sentence"]).where(F.abs(F.col("hs") - F.col("ts")) <= reach).select("doc_id", "head", "tail", F.abs(F.col("hs") - F.col("ts")).alias("distance"))


def review_queue(items: DataFrame, risk: str, score: str, id_col: str, limit: int) -> DataFrame:
    """The next items for review: highest risk, then least sure, then id."""
    return items.orderBy(F.col(risk).desc(), F.col(score), F.col(id_col)).limit(limit)


def shard_report(shards: DataFrame) -> DataFrame:
    """status, shards, documents, seconds of a run."""
    return shards.groupBy("status").agg(F.count("*").alias("shards"), F.sum("documents").alias("documents"), F.round(F.sum("seconds"), 3).alias("seconds"))
