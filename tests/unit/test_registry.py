"""Every registered query against its oracle, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quillfold.plans.catalogue import ORACLE, QUERIES, flagship


def norm(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float):
            return None if v != v else round(v, 6)
        return str(v)[:19] if hasattr(v, "isoformat") else v

    return sorted(str([cell(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in ORACLE:
        r = con.execute(ORACLE[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert norm(rows, df.columns) == norm(r.fetchall(), columns)


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


def test_masking_stays_in_the_jvm(spark, sf):
    for name in ("redact_mask", "kanon_report", "cohort_and", "arbitrate_balanced", "shift_dates_patient"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
