"""Visible text of HTML pages: a Column expression for tables, a parser with source offsets for redaction."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The entities that stand for markup characters.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HIDDEN = ("script", "style", "template", "noscript", "head")


def visible_text(html: Column | str) -> Column:
    """Scripts, styles, comments and tags become a space; markup entities are read; white space is collapsed."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


class _Reader(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.rows: list[tuple[str, int, int]] = []
        self.hidden, self.source = 0, source
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            start = self._at()
            self.rows.append((data, start, start + len(data)))


def text_runs(html: str | None) -> list[tuple[str, int, int]]:
    """(text, start, end) of visible runs, with offsets into the source."""
    reader = _Reader(html or "")
    reader.feed(html or "")
    reader.close()
    return reader.rows


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, run, start, end, text: one row for each visible run of each page."""

    def read(batches):
        import pandas as pd

        for b in batches:
            rows = [(i, k, s, e, t) for i, html in zip(b[id_col], b[html_col]) for k, (t, s, e) in enumerate(text_runs(html))]
            yield pd.DataFrame(rows, columns=["id", "run", "start", "end", "text"])

    key = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(read, f"id {key}, run int, start int, end int, text string")
