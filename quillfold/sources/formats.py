"""Documents of common formats as rows of text, read as binary files and parsed in Arrow batches.

Kinds go by the file's suffix: plain text, Markdown, HTML, RTF, e-mail, vCard, iCalendar, and the zipped XML of DOCX, ODT,
EPUB, PPTX and XLSX. Everything is parsed with the standard library; a file that its kind's parser does not understand
gives a null text and an error, never another file's row. XML with a document type declaration is refused, and so is an
archive that would inflate beyond ``MOST_INFLATED``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from html import unescape
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import prepare

MOST_INFLATED = 256 << 20


def _decoded(data: bytes) -> str:
    """By the byte order mark, as UTF-8, else as Windows-1252 (bytes that it lacks as themselves)."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name)
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)


def markdown(data: bytes) -> str:
    """The words of a Markdown text: marks of headings, emphasis, lists, quotes and fences go, links keep their words."""
    text = re.sub(r"^```.*$", "", _decoded(data), flags=re.M)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"^\s{0,3}(#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "", text, flags=re.M)
    text = re.sub(r"^\s{0,3}([-*_]\s*){3,}$", "", text, flags=re.M)
    return re.sub(r"(\*\*|__|`|(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w))", "", text).strip()


def html(data: bytes) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", _decoded(data))
    text = re.sub(r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n", text)
    return _lines(unescape(re.sub(r"(?s)<[^>]*>", " ", text)))


def _lines(text: str) -> str:
    """Runs of blanks to one space, lines trimmed, empty lines gone."""
    rows = (" ".join(line.split()) for line in text.splitlines())
    return "\n".join(r for r in rows if r)


def rtf(data: bytes) -> str:
    """The words of a rich text: control words go, paragraphs and tabs stay, hidden destinations are left out."""
    out, stack, hidden, skip = [], [], False, 0
    uc = 1
    for m in re.finditer(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|\r?\n|([^\\{}\r\n])", data, re.S):
        word, number, code, sign, brace, char = m.groups()
        if brace == b"{":
            stack.append((hidden, uc))
        elif brace == b"}":
            hidden, uc = stack.pop() if stack else (False, 1)
        elif sign == b"*" or word in (b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer"):
            hidden = True
        elif hidden:
            continue
        elif word == b"uc":
            uc = int(number or 1)
        elif word == b"u":
            out.append(chr(int(number) % 65536))
            skip = uc
        elif word in (b"par", b"line", b"sect", b"page", b"tab", b"cell", b"row"):
            out.append("\t" if word in (b"tab", b"cell") else "\n")
        elif word is None and (code or char or sign):
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace") if code else {b"~": "\u00a0", b"-": "", b"_": "-"}.get(sign, sign.decode("latin-1")) if sign else char.decode("latin-1"))
    return _lines("".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def mail(data: bytes) -> str:
    """Subject, sender and receivers, then the plain body, or the words of the HTML one. Attachments are left out."""
    m = message_from_bytes(data, policy=policy.default)
    if not m.keys():
        raise ValueError("no headers")
    head = [f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if m[k]]
    body = m.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    return "\n".join([*head, "", html(text.encode()) if body is not None and body.get_content_subtype() == "html" else text.strip()]).strip()


def card(data: bytes) -> str:
    """vCard and iCalendar: a line ``NAME: value`` for each property, folded lines joined, escapes undone."""
    text = re.sub(r"\r?\n[ \t]", "", _decoded(data))
    rows = [re.match(r"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)?)((?:;[^:]*)?):(.*)", line) for line in text.splitlines()]
    if not any(r and r[1].upper() == "BEGIN" for r in rows):
        raise ValueError("nothing begins")
    undo = lambda v: re.sub(r"\\([,;\\nN])", lambda x: "\n" if x[1] in "nN" else x[1], v)
    return "\n".join(f"{r[1].upper()}: {undo(r[3]).strip()}" for r in rows if r and r[1].upper() not in ("BEGIN", "END", "VERSION", "PRODID"))


def _parts(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > MOST_INFLATED:
            raise ValueError("the archive is too large")
        return {i.filename: z.read(i) for i in z.infolist() if i.filename.endswith((".xml", ".xhtml", ".html", ".htm", ".opf"))}


def _tree(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(data)


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _paragraphs(data: bytes, names: tuple[str, ...], leaf: str | None) -> list[str]:
    """Text of each paragraph: of its ``leaf`` elements, or all of its text."""
    out = []
    for p in _tree(data).iter():
        if _tag(p) in names:
            out.append("".join("\t" if _tag(x) == "tab" else (x.text or "") for x in p.iter() if leaf is None or _tag(x) in (leaf, "tab")) if leaf else "".join(p.itertext()))
    return out


def _number(name: str) -> int:
    return int(re.sub(r"\D", "", name.rsplit("/", 1)[-1]) or 0)


def docx(data: bytes) -> str:
    return _lines("\n".join(_paragraphs(_parts(data)["word/document.xml"], ("p",), "t")))


def pptx(data: bytes) -> str:
    parts = _parts(data)
    return _lines("\n".join(x for n in sorted((n for n in parts if re.match(r"ppt/slides/slide\d+\.xml", n)), key=_number) for x in _paragraphs(parts[n], ("p",), "t")))


def odt(data: bytes) -> str:
    return _lines("\n".join(_paragraphs(_parts(data)["content.xml"], ("p", "h"), None)))


def epub(data: bytes) -> str:
    """The parts of the spine, in its order."""
    parts = _parts(data)
    where = next(n for n in parts if n.endswith(".opf"))
    book, base = _tree(parts[where]), where.rpartition("/")[0]
    items = {e.get("id"): e.get("href") for e in book.iter() if _tag(e) == "item"}
    names = ["/".join(filter(None, [base, items[e.get("idref")]])) for e in book.iter() if _tag(e) == "itemref"]
    return "\n".join(html(parts[n]) for n in names if n in parts)


def xlsx(data: bytes) -> str:
    """A line for each row of each sheet, cells by tabs."""
    parts = _parts(data)
    shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in _tree(parts["xl/sharedStrings.xml"]) if _tag(si) == "si"] if "xl/sharedStrings.xml" in parts else []
    out = []
    for n in sorted((n for n in parts if re.match(r"xl/worksheets/sheet\d+\.xml", n)), key=_number):
        for row in (e for e in _tree(parts[n]).iter() if _tag(e) == "row"):
            cells = []
            for c in (e for e in row if _tag(e) == "c"):
                value = next((x.text or "" for x in c if _tag(x) == "v"), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else "".join(x.text or "" for x in c.iter() if _tag(x) == "t") if c.get("t") == "inlineStr" else value)
            out.append("\t".join(cells))
    return "\n".join(out)


KINDS: dict[str, Callable[[bytes], str]] = {"txt": _decoded, "md": markdown, "markdown": markdown, "html": html, "htm": html, "xhtml": html, "rtf": rtf, "eml": mail, "vcf": card, "ics": card, "docx": docx, "odt": odt, "epub": epub, "pptx": pptx, "xlsx": xlsx}


def parsed(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, kind, text, error: a row for each file. Kinds that are not known, null contents and broken files have an error."""
    prepare(files.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for lo in range(0, whole.num_rows, 16):
                batch, rows = whole.slice(lo, 16), []
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    kind = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
                    try:
                        if kind not in KINDS:
                            raise ValueError("the kind is not known")
                        if not data.is_valid:
                            raise ValueError("there is no content")
                        rows.append((path, kind, KINDS[kind](data.as_py()), None))
                    except Exception as e:  # a broken file is a row with its reason
                        rows.append((path, kind, None, f"{type(e).__name__}: {e}"[:200]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "kind", "text", "error"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, "path string, kind string, text string, error string")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``parsed`` for all files of known kinds below a folder."""
    pattern = "*.{" + ",".join([*KINDS, *(k.upper() for k in KINDS)]) + "}"
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content"))
