"""Linked tables: surrogates that keep foreign keys, one date offset for each subject, and reference checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import date_shift_days, hmac_sha256


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key is not null and has no parent."""
    keys = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def surrogate(secret: bytes, domain: str, column: str):
    """The surrogate of an identifier: equal identifiers of a domain have equal surrogates in every table."""
    return F.substring(hmac_sha256(secret, F.concat(F.lit(f"{domain}:"), F.col(column).cast("string"))), 1, 16)


@dataclass(frozen=True)
class TableSpec:
    """What to do with a table's columns: identifiers by domain, dates to shift, columns to drop, references to check."""

    identifiers: dict[str, str] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    subject: str | None = None
    drop: tuple[str, ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()  # (column, table, its key)


def deidentify_tables(tables: dict[str, DataFrame], specs: dict[str, TableSpec], secret: bytes, max_days: int = 365) -> dict[str, DataFrame]:
    """All tables with surrogates for identifiers and dates shifted by their subject's offset.

    Keys are hashed where they stand, so no mapping table is joined. A dangling reference is refused, and so is a table
    with dates to shift but no subject.
    """
    out = {}
    for name, df in tables.items():
        spec = specs.get(name, TableSpec())
        if spec.dates and not spec.subject:
            raise ValueError("a table with dates to shift needs a subject column")
        for fk, parent, pk in spec.references:
            if not orphans(df, fk, tables[parent], pk).isEmpty():
                raise ValueError("a foreign key has no parent row")
        cols = []
        for c in df.columns:
            if c in spec.drop:
                continue
            if c in spec.identifiers:
                cols.append(surrogate(secret, spec.identifiers[c], c).alias(c))
            elif c in spec.dates:
                cols.append(F.date_add(F.col(c).cast("date"), date_shift_days(secret, spec.subject, max_days)).alias(c))
            else:
                cols.append(F.col(c))
        out[name] = df.select(*cols)
    return out


def subject_consistency(text_links: DataFrame, table_links: DataFrame) -> DataFrame:
    """Subjects whose surrogate differs between two (subject, surrogate) relations, or that have several."""
    both = text_links.select("subject", "surrogate").unionByName(table_links.select("subject", "surrogate"))
    return both.groupBy("subject").agg(F.count_distinct("surrogate").alias("surrogates")).where("surrogates > 1")
