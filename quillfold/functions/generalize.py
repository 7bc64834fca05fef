"""Generalisation rungs: level 0 is the value itself, the last level is ``*``. Invalid input is an error, not a guess."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGE_WIDTHS = (5, 10, 20)
SUPPRESSED = "*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_band(age: Column | str, width: int) -> Column:
    """``lower-upper`` of the band, capped at 89; ``90+`` from 90. Ages outside 0 to 150 raise."""
    a = _col(age).try_cast("int")
    low = F.floor(a / width) * width
    band = F.concat(low.cast("string"), F.lit("-"), F.least(low + width - 1, F.lit(89)).cast("string"))
    return F.when(a.between(0, 150), F.when(a >= 90, "90+").otherwise(band)).when(_col(age).isNotNull(), F.raise_error(F.lit("an age is not between 0 and 150")).cast("string"))


def zip_prefix(code: Column | str, drop: int) -> Column:
    """The code without its last ``drop`` characters; ``*`` when none is left. Other than letters and digits raises."""
    c = F.trim(_col(code).cast("string"))
    kept = F.when(F.length(c) - drop > 0, F.substring(c, F.lit(1), F.length(c) - F.lit(drop))).otherwise(SUPPRESSED)
    return F.when(c.rlike("^[0-9A-Za-z]+$"), kept).when(c.isNotNull(), F.raise_error(F.lit("a postal code is not alphanumeric")).cast("string"))


def date_month(d: Column | str) -> Column:
    return F.date_format(_col(d).cast("date"), "yyyy-MM")


def date_year(d: Column | str) -> Column:
    return F.date_format(_col(d).cast("date"), "yyyy")


def ladder(kind: str) -> list[Callable[[Column], Column]]:
    """The rungs of a type from exact to suppressed: age (5), zip (8), date (4), other (2)."""
    exact = lambda c: c.cast("string")
    gone = lambda c: F.lit(SUPPRESSED)
    if kind == "age":
        return [exact, *(lambda c, w=w: age_band(c, w) for w in AGE_WIDTHS), gone]
    if kind == "zip":
        return [exact, *(lambda c, k=k: zip_prefix(c, k) for k in range(1, 7)), gone]
    if kind == "date":
        return [exact, date_month, date_year, gone]
    return [exact, gone]


def generalize_value(kind: str, value: Column | str, level: int) -> Column:
    """One rung of a type's ladder; a level beyond it raises."""
    rungs = ladder(kind)
    if not 0 <= level < len(rungs):
        raise ValueError(f"{kind} has levels 0 to {len(rungs) - 1}")
    return rungs[level](_col(value))


def from_hierarchy(value: Column | str, chains: dict[str, list[str]], level: int) -> Column:
    """A caller's hierarchy: each leaf has its ancestors from fine to coarse; unknown leaves are suppressed."""
    pairs = [F.lit(x) for leaf, up in chains.items() for x in (leaf, [leaf, *up, SUPPRESSED][min(level, len(up) + 1)])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(value)), F.lit(SUPPRESSED)) if pairs else F.lit(SUPPRESSED)
