"""The queries of this subpackage on the smallest tables: against their SQL where they have some, else by what must hold."""

import os

import pytest

from quillspan.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cur.fetchall())


def test_p1_repeats_an_accepted_record_that_came_before(spark, data, duck):
    rows = QUERIES["p1_found"](spark, data).collect()
    order = dict(duck.execute("SELECT rec_id, (batch_no, rec_id) FROM incoming_candidates").fetchall())
    repeats = {r["repeat_rec_id"] for r in rows}
    assert rows and len(repeats) == len(rows)
    place = lambda i: tuple(order[i].values()) if isinstance(order[i], dict) else tuple(order[i])
    for r in rows:
        assert r["accepted_rec_id"] not in repeats and place(r["accepted_rec_id"]) < place(r["repeat_rec_id"]) and place(r["repeat_rec_id"])[0] > 0


def test_p7_holds_every_document_within_capacity(spark, data, duck):
    rows = QUERIES["p7_packed"](spark, data).collect()
    capacity = dict(duck.execute("SELECT profile, capacity_tokens FROM pack_profiles").fetchall())
    n = duck.execute("SELECT count(*) FROM documents WHERE text IS NOT NULL").fetchone()[0]
    fill, docs = {}, {}
    for r in rows:
        fill[r["profile"], r["container"]] = fill.get((r["profile"], r["container"]), 0) + r["n_tokens"]
        docs.setdefault(r["profile"], set()).add(r["doc_id"])
    assert set(docs) == set(capacity) and all(v <= capacity[p] for (p, _), v in fill.items()) and all(len(d) == n for d in docs.values())
    shown = {r["profile"]: r for r in QUERIES["p7_fill"](spark, data).collect()}
    assert all(shown[p]["containers"] == sum(q == p for q, _ in fill) and 0 < shown[p]["filled"] <= 1 for p in capacity)


def test_p8_uses_and_shares(spark, data, duck):
    mix = QUERIES["p8_mixture"](spark, data).collect()
    shares = {r["source"]: r for r in QUERIES["p8_shares"](spark, data).collect()}
    most = dict(duck.execute("SELECT source, max_repeats FROM mix_targets").fetchall())
    assert set(shares) == set(most) and sum(r["n_tokens"] for r in mix) == sum(r["n_tokens"] for r in shares.values()) <= max(r["budget"] for r in shares.values())
    assert all(0 <= r["copy"] < most[r["source"]] for r in mix)
    at = 0
    for r in sorted(mix, key=lambda r: (r["mix_offset"], r["n_tokens"])):
        assert r["mix_offset"] == at
        at += r["n_tokens"]
