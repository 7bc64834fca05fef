"""Health data interchange: pipe-delimited messages, claims, XML documents, resource bundles.

Messages are split by their own delimiters into long tables (message, segment number, segment, field, value), changed
there or in place by array expressions, and joined again; framing comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import date_shift_days
from ..operators.spans import mask_by_patterns

#: Fields of HL7 v2 segments that name or describe a person, and what is done to them.
HL7_ACTIONS = {("PID", 3): "hash", ("PID", 5): "clear", ("PID", 7): "date-shift", ("PID", 11): "clear", ("PID", 13): "clear", ("PID", 14): "clear", ("PID", 19): "hash", ("NK1", 2): "clear", ("NK1", 5): "clear", ("PV1", 7): "clear", ("IN1", 36): "hash", ("OBX", 5): "redact_text", ("NTE", 3): "redact_text"}
TEXT_LABELS = ["EMAIL", "PHONE", "SSN", "URL"]


def hl7_fields(messages: DataFrame, id_col: str = "id", text_col: str = "message") -> DataFrame:
    """id, seq, segment, field, value. MSH-1 is the separator itself, so fields of MSH count from 2."""
    m = messages.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r\n|\r|\n")).alias("seq", "line")).where("length(line) > 2")
    parts = m.select("id", "seq", F.substring("line", 1, 3).alias("segment"), F.posexplode(F.split("line", r"\|")).alias("at", "value"))
    return parts.where("at > 0").select("id", "seq", "segment", (F.col("at") + F.when(F.col("segment") == "MSH", 1).otherwise(0)).alias("field"), "value")


def _hl7_value(action: str, value: Column, secret: bytes, key: Column, max_days: int) -> Column:
    if action == "clear":
        return F.when(F.length(value) > 0, "").otherwise(value)
    if action == "hash":
        return F.when(F.length(value) > 0, F.substring(F.sha2(value.cast("binary"), 256), 1, 16)).otherwise(value)
    if action == "date-shift":
        day = F.call_function("try_to_date", F.substring(value, 1, 8), F.lit("yyyyMMdd"))
        return F.when(day.isNotNull(), F.concat(F.date_format(F.date_add(day, date_shift_days(secret, key, max_days)), "yyyyMMdd"), F.substring(value, 9, 100))).otherwise("")
    return mask_by_patterns(value, TEXT_LABELS)


def redact_hl7(messages: DataFrame, secret: bytes, id_col: str = "id", text_col: str = "message", actions: dict = HL7_ACTIONS, max_days: int = 365) -> DataFrame:
    """The messages with the fields of ``actions`` redacted; separators, segment ends and other fields stay."""
    end = F.when(F.col(text_col).contains("\r\n"), "\r\n").when(F.col(text_col).contains("\r"), "\r").otherwise("\n")

    def line(x: Column) -> Column:
        parts, seg = F.split(x, r"\|"), F.substring(x, 1, 3)

        def cell(v: Column, i: Column) -> Column:
            out = v
            for (segment, field), action in actions.items():
                out = F.when((seg == segment) & (i == field), _hl7_value(action, v, secret, F.col(id_col).cast("string"), max_days)).otherwise(out)
            return out

        return F.when(seg == "MSH", x).otherwise(F.array_join(F.transform(parts, cell), "|"))

    return messages.withColumn(text_col, F.call_function("array_join", F.transform(F.split(text_col, "\r\n|\r|\n"), line), end))


def hl7_narrative(messages: DataFrame, id_col: str = "id", text_col: str = "message") -> DataFrame:
    """id, seq, text of free-text results and notes."""
    f = hl7_fields(messages, id_col, text_col)
    kind = f.where("segment = 'OBX' AND field = 2 AND value IN ('FT', 'TX')").select("id", "seq")
    return f.where("segment = 'OBX' AND field = 5").join(kind, ["id", "seq"], "left_semi").unionByName(f.where("segment = 'NTE' AND field = 3")).select("id", "seq", F.col("value").alias("text"))


#: X12 837 elements that name a person, by segment; NM1 also after its entity code.
X12_CLEAR = {"NM1": (3, 4, 5, 9), "N3": (1, 2), "N4": (1, 3), "DMG": (2,), "REF": (2,), "PER": (2, 4, 6, 8)}


def x12_elements(claims: DataFrame, id_col: str = "id", text_col: str = "claim") -> DataFrame:
    """id, seq, segment, element, value, hl: the hierarchical loop that the segment belongs to."""
    s = claims.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.regexp_replace(text_col, "[\r\n]", ""), "~")).alias("seq", "line")).where("length(line) > 0")
    s = s.withColumn("parts", F.split("line", r"\*")).withColumn("segment", F.element_at("parts", 1))
    order = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("hl", F.last(F.when(F.col("segment") == "HL", F.get("parts", F.lit(1))), ignorenulls=True).over(order))
    return s.select("id", "seq", "segment", "hl", F.posexplode("parts").alias("element", "value")).where("element > 0")


def redact_x12(claims: DataFrame, text_col: str = "claim", clear: dict = X12_CLEAR) -> DataFrame:
    def segment(x: Column) -> Column:
        parts = F.split(x, r"\*")
        name = F.regexp_replace(F.element_at(parts, 1), "[\r\n ]", "")

        def cell(v: Column, i: Column) -> Column:
            out = v
            for seg, elements in clear.items():
                out = F.when((name == seg) & i.isin(*elements) & (F.length(v) > 0), "X").otherwise(out)
            return out

        return F.array_join(F.transform(parts, cell), "*")

    return claims.withColumn(text_col, F.array_join(F.transform(F.split(text_col, "~"), segment), "~"))


#: XML elements of clinical documents whose text names a person.
CDA_ELEMENTS = ("given", "family", "prefix", "suffix", "streetAddressLine", "postalCode", "city")


def redact_cda(documents: DataFrame, text_col: str = "xml") -> DataFrame:
    """Names and addresses emptied, birth times cut to the year, telecom values and identifiers hidden, narratives masked.

    Documents with a document type or entity declaration are refused: their text becomes null.
    """
    out = F.col(text_col)
    for tag in CDA_ELEMENTS:
        out = F.regexp_replace(out, rf"<((?:[A-Za-z0-9]+:)?{tag})((?: [^>]*)?)>[^<]*</((?:[A-Za-z0-9]+:)?{tag})>", "<$1$2></$3>")
    out = F.regexp_replace(out, r'(<(?:[A-Za-z0-9]+:)?birthTime value=")([0-9]{4})[0-9]*(")', "$1$2$3")
    out = F.regexp_replace(out, r'(<(?:[A-Za-z0-9]+:)?telecom [^>]*value=")[^"]*(")', "$1$2")
    out = F.regexp_replace(out, r'(<(?:[A-Za-z0-9]+:)?id [^>]*extension=")[^"]*(")', "$1X$2")
    unsafe = F.col(text_col).rlike(r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b")
    return documents.withColumn(text_col, F.when(~unsafe, mask_by_patterns(out, TEXT_LABELS)))


def cda_sections(documents: DataFrame, id_col: str = "id", text_col: str = "xml") -> DataFrame:
    """id, n, title, text of the sections of an XML document."""
    plain = F.regexp_replace(text_col, 'xmlns(:[A-Za-z0-9]+)?="[^"]*"', "")
    titles, texts = F.xpath(plain, F.lit("//section/title/text()")), F.xpath(plain, F.lit("//section/text/text()"))
    return documents.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(titles.alias("title"), texts.alias("text"))).alias("n", "s")).select("id", "n", "s.title", "s.text")


def fhir_resources(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """type, id, references, resource of bulk NDJSON lines; lines that are no JSON object go."""
    r = F.col(json_col)
    refs = F.regexp_extract_all(r, F.lit(r'"reference"\s*:\s*"([A-Za-z]+/[A-Za-z0-9.-]+)"'), 1)
    rows = lines.select(F.get_json_object(r, "$.resourceType").alias("type"), F.get_json_object(r, "$.id").alias("id"), refs.alias("references"), r.alias("resource"))
    return rows.where("type IS NOT NULL")


def dangling_references(resources: DataFrame) -> DataFrame:
    """source, reference: references to resources that aren't there."""
    have = resources.select(F.concat_ws("/", "type", "id").alias("target")).distinct()
    asked = resources.select(F.concat_ws("/", "type", "id").alias("source"), F.explode("references").alias("reference"))
    return asked.join(have, asked["reference"] == have["target"], "left_anti")


def redact_fhir(resources: DataFrame) -> DataFrame:
    """Person names, contacts, addresses and narratives leave the resource; birth dates keep their year."""
    out = F.col("resource")
    for field in ("name", "telecom", "address", "photo", "contact"):
        out = F.regexp_replace(out, rf'"{field}"\s*:\s*\[(?:[^\[\]]|\[[^\[\]]*\])*\]', f'"{field}":[]')
    out = F.regexp_replace(out, r'"birthDate"\s*:\s*"([0-9]{4})[^"]*"', '"birthDate":"$1"')
    out = F.regexp_replace(out, r'"div"\s*:\s*"(?:[^"\\]|\\.)*"', '"div":""')
    return resources.withColumn("resource", F.when(F.col("type").isin("Patient", "Practitioner", "RelatedPerson"), out).otherwise(mask_by_patterns(F.col("resource"), TEXT_LABELS)))
