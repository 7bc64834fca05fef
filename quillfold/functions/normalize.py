"""Unicode normal forms with a map back to the source, and the projection of spans through it.

A text is cut where its normal form is the concatenation of its parts' forms; each character of a part's form stems from
the part's place in the source. Texts already in the form, as nearly all are, map onto themselves and carry no map.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMS = ("NFC", "NFKC", "NFD", "NFKD")
#: Bytes of forms and maps, about, after which a worker hands its rows on.
FLUSH = 8 << 20


def parts(text: str, form: str) -> list[tuple[int, int]]:
    """(start, end) of the parts whose forms, one after the other, are the text's form."""
    out, start = [], 0
    for i in range(1, len(text)):
        c = text[i]
        if c < "\x80":  # no ASCII character follows on another in any form
            out.append((start, i))
            start = i
            continue
        if unicodedata.combining(c) or unicodedata.combining(unicodedata.normalize(form, c)[0]):
            continue
        held = text[start:i]
        if unicodedata.normalize(form, held + c) == unicodedata.normalize(form, held) + unicodedata.normalize(form, c):
            out.append((start, i))
            start = i
    return [*out, (start, len(text))] if text else []


def mapped(text: str, form: str) -> tuple[str, list[int] | None]:
    """The form, and for each of its characters and its end the place in the source; no map if nothing changes."""
    if unicodedata.is_normalized(form, text):
        return text, None
    out, places = [], []
    for a, b in parts(text, form):
        new = unicodedata.normalize(form, text[a:b])
        same = len(new) == b - a
        out.append(new)
        places += range(a, b) if same else [a] * len(new)
    return "".join(out), [*places, len(text)]


def normal_form(text: Column | str, form: str = "NFC", places: bool = True) -> Column:
    """struct(text, places): the normal form and its map, null where the text is its own form. A null text gives nulls.

    Without ``places`` no map is made, and all are null. Results leave a worker in chunks of about ``FLUSH`` bytes, however
    many rows come in at once.
    """
    if form not in FORMS:
        raise ValueError(f"unknown form: {form}")

    @F.pandas_udf("text string, places array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, held = [], 0
            for t in texts:
                new, at = (None, None) if t is None else mapped(t, form) if places else (unicodedata.normalize(form, t), None)
                rows.append((new, None if at is None else np.array(at, dtype=np.int32)))
                held += len(new or "") + (0 if at is None else 4 * len(at))
                if held > FLUSH:
                    yield pd.DataFrame(rows, columns=["text", "places"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["text", "places"])

    return run(F.col(text) if isinstance(text, str) else text)


def source_span(places: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the source of a span of the normal form. It ends where the next character's part begins, so a
    part is never cut; a span beyond the text has no place."""
    a = F.when(places.isNull(), start).otherwise(F.get(places, start))
    last = F.get(places, end - 1)
    beyond = F.array_min(F.filter(F.slice(places, end + 1, F.size(places)), lambda p: p > last))
    b = F.when(places.isNull(), end).when(end > start, F.coalesce(beyond, last)).otherwise(a)
    return F.struct(a.alias("start"), b.alias("end"))
