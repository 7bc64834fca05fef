"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at the hits, embedded checksum validation.

One pass of an automaton over the lowered bytes of a text finds all keywords; an expression is tried only where its
keyword starts. Runs of hexadecimal digits have no keyword and are their own prefilter. Kinds with an embedded checksum
(``github``, ``npm``, ``xprv``) are reported only where it holds; the base kinds are reported as matched.

Spans are half-open code-point offsets, in the order of start, then of ``KINDS``. Within a kind they are leftmost and
do not overlap.

Defined cases: null and empty texts have no spans; equal rows have equal results; an empty table gives an empty result;
other columns are kept by ``redact`` and ignored by ``scan``. A batch is worked on in parts of bounded text; a very long
text is a part of its own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .encode import slices, trim
from .work import prepare

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE = KINDS[:3]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
CHECKED = {
    "github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "xprv": re.compile(rb"xprv([1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])"),
}
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
    "xprv": "xprv",
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of the body in base 62, six digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r : r + 1] + out
    return out


def base58_check(text: bytes) -> bool:
    """Whether the last four of the bytes are the doubled SHA-256 of those before."""
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    data = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def _valid(kind: str, m: re.Match) -> bool:
    return base58_check(m[0]) if kind == "xprv" else base62_crc(m[1]) == m[2]


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(data)]
    ends = dict.fromkeys(KINDS, 0)
    for last, (length, kind) in sorted((i - n + 1, (n, k)) for i, (n, k) in _automaton().iter(data.lower().decode("latin-1"))):
        start = last
        if start < ends[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(data, start):
                ends[kind] = m.end()
                if len(m[2]) >= 12:
                    spans.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(data, start):
                ends[kind] = m.end()
                if m.end() - start >= 18:
                    spans.append((start, m.end(), kind))
        elif (m := CHECKED[kind].match(data, start)) and _valid(kind, m):
            ends[kind] = m.end()
            spans.append((start, m.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if len(data) != len(text):
        points, at, done = {}, 0, 0
        for byte in sorted({x for s in spans for x in s[:2]}):
            at += len(data[done:byte].decode("utf-8", "surrogatepass"))
            done, points[byte] = byte, at
        spans = [(points[a], points[b], k) for a, b, k in spans]
    return spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (start, end, kind) for each row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for whole in batches:
            for batch in slices(whole):
                found = [[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t.as_py())] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])
        trim()

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {key}, spans array<struct<start:int,end:int,kind:string>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from ``scan``."""
    from pyspark.sql import functions as F

    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every secret replaced by its kind in brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, secrets masked; ``chars_col``, if there is one, follows."""
    prepare(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for whole in batches:
            for batch in slices(whole, at):
                cols = list(batch.columns)
                texts = cols[at].to_pylist()
                new = [masked(t, find_secrets(t)) for t in texts]
                if chars_col in names:
                    k = names.index(chars_col)
                    old = cols[k].to_pylist()
                    cols[k] = pa.array([o if n is None or n == t else len(n) for o, n, t in zip(old, new, texts)], cols[k].type)
                cols[at] = pa.array(new, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    return docs.mapInArrow(run, docs.schema)
