"""Logs and conversation traces: nested JSON whose texts are redacted and whose shape stays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spans import PATTERNS, mask_by_patterns

TEXT_KEYS = ("content", "text", "input", "output", "arguments", "message", "chosen", "rejected", "prompt", "value")


def redact_messages(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """An array of structs with a ``content`` field, each content masked; no Python, shape unchanged."""
    return rows.withColumn(column, F.transform(column, lambda m: m.withField("content", mask_by_patterns(m["content"], labels))))


def redact_log_fields(lines: DataFrame, fields: list[str], labels: list[str], json_col: str = "value") -> DataFrame:
    """NDJSON events with these top-level text fields masked: the event as a map of raw JSON, joined again."""
    out = lines
    for f in fields:
        old = F.get_json_object(json_col, f"$.{f}")
        quoted = F.get(F.split(F.to_json(F.array(mask_by_patterns(old, labels))), r"^\["), F.lit(1))
        body = F.regexp_replace(quoted, r"\]$", "")
        safe = F.regexp_replace(body, r"([\\$])", r"\\$1")
        pattern = rf'("{f}"\s*:\s*)"(?:[^"\\]|\\.)*"'
        out = out.withColumn(json_col, F.when(old.isNotNull(), F.call_function("regexp_replace", F.col(json_col), F.lit(pattern), F.concat(F.lit("$1"), safe))).otherwise(F.col(json_col)))
    return out


def mask_text(text: str, labels: list[str]) -> str:
    for label in labels:
        text = re.sub(PATTERNS[label], lambda m, label=label: f"{m[1]}[{label}]", text, flags=re.ASCII)
    return text


def rewrite(node, labels: list[str], inside: bool = False):
    """A JSON value with every text below a text key masked; JSON inside tool arguments is read and written again."""
    if isinstance(node, dict):
        return {k: rewrite(v, labels, inside or k in TEXT_KEYS) for k, v in node.items()}
    if isinstance(node, list):
        return [rewrite(v, labels, inside) for v in node]
    if isinstance(node, str) and inside:
        if node[:1] in "{[" and node[-1:] in "}]":
            try:
                return json.dumps(rewrite(json.loads(node), labels, True), ensure_ascii=False)
            except ValueError:
                pass
        return mask_text(node, labels)
    return node


def redact_traces(lines: DataFrame, labels: list[str], json_col: str = "value") -> DataFrame:
    """JSONL records of any depth, rewritten; lines that are no JSON stay out, with ``valid`` false and a null value."""
    names = lines.columns

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out, good = [], []
            for x in b[json_col]:
                try:
                    out.append(json.dumps(rewrite(json.loads(x), labels), ensure_ascii=False))
                    good.append(True)
                except (TypeError, ValueError):
                    out.append(None)
                    good.append(False)
            yield b.assign(**{json_col: out}, valid=good)[[*names, "valid"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields) + ", valid boolean"
    return lines.mapInPandas(run, schema)


def shape(node):
    """The structure of a JSON value: keys, lengths and kinds, no texts."""
    if isinstance(node, dict):
        return {k: shape(v) for k, v in node.items()}
    if isinstance(node, list):
        return [shape(v) for v in node]
    return type(node).__name__


def same_shape(before: str, after: str) -> bool:
    return shape(json.loads(before)) == shape(json.loads(after))


def inventory(turns: DataFrame, labels: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """role, label, turns with a finding: counts only."""
    marks = F.explode(F.array_compact(F.array(*(F.when(F.col(text).rlike(PATTERNS[x]), F.lit(x)) for x in labels))))
    return turns.select(role, marks.alias("label")).groupBy(role, "label").agg(F.count("*").alias("turns"))


def discover(spark, path: str) -> DataFrame:
    """path, bytes, modified of trace files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
