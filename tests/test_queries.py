"""Every query of the core against its SQL, on the smallest tables."""

import os

import pytest

from quillspan.plans.catalogue import QUERIES, SQL


def rows_of(names, values):
    out = []
    for r in values:
        d = dict(zip(names, r, strict=True))
        cells = []
        for n in sorted(names):
            v = d[n]
            if hasattr(v, "tzinfo") and v.tzinfo is not None:
                v = v.replace(tzinfo=None)
            if isinstance(v, float) or type(v).__name__ == "Decimal":
                v = round(float(v), 5) + 0.0
            cells.append(str(int(v)) if isinstance(v, float) and v == int(v) else str(v).removesuffix(" 00:00:00"))
        out.append("|".join(cells))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["q39_select_general", "q40_select_engineering", "q41_select_bio"])
def test_selection_queries_hold_their_limits(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    per = {}
    for r in rows:
        per.setdefault(r["issue_date"], []).append(r["place"])
    assert rows
    for places in per.values():
        assert sorted(places) == list(range(1, len(places) + 1)) and len(places) <= 10
