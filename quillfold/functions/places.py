"""Places of matches in a text, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; written out in place, each use inside a lambda would work it out anew."""
    return F.get(F.transform(F.array(value), use), 0)


def occurrences(text: Column | str, pattern: str, group: int = 2, whole: Column | None = None) -> Column:
    """Array of (start, end, surface). Places are sums of the lengths of matches and of what stands between them."""
    t = F.col(text) if isinstance(text, str) else text
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)) if whole is None else whole
    inner, gaps = (whole if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))), F.split(t, pattern)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,surface:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        stop = acc["at"] + F.char_length(m["gap"]) + F.char_length(m["whole"])
        row = F.struct((stop - F.char_length(m["inner"])).alias("start"), stop.alias("end"), m["inner"].alias("surface"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    parts = F.arrays_zip(whole.alias("whole"), inner.alias("inner"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"))
    return F.when(F.size(whole) > 0, F.aggregate(parts, state, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,end:int,surface:string>>"))
