"""Queries under their SQL's name equal it on tables with records that only the whole queries take."""

import random
from datetime import date, datetime, timedelta

import pytest

from quillspan.plans.catalogue import QUERIES, SQL
from test_events import VOCABULARY
from test_queries import rows_of
from test_whole_queries import CANDIDATES, candidate, write


def equals_sql(spark, path, name, *tables):
    con = pytest.importorskip("duckdb").connect()
    con.execute("SET timezone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, path)
    got, stated = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names) and got == stated and got
    return len(got)


def test_q21_takes_documents_in_english(spark, tmp_path):
    texts = [("A", "A: one\u00a0two. Three!\u00a0Four. Five."), ("B", "One.\tTwo?\n\nThree."), (None, None), ("Long", "x" * 400), ("C", "c - rest. More. Last.")]
    rows = [(10 * i + j, lang, title, text) for i, (title, text) in enumerate(texts) for j, lang in enumerate(["en", "EN", "de", "", None])]
    path = write(spark, tmp_path, "documents", rows, "doc_id long, lang string, title string, text string")
    assert equals_sql(spark, path, "q21_extract_summary", "documents") == len(texts)


def test_q35_caps_searched_sites_too(spark, tmp_path):
    names = [("feed", "rss", None, True, 2), ("site", "website", None, True, 3), ("named", "website", "rss", True, None), ("shut", "rss", None, True, 0)]
    write(spark, tmp_path, "sources", names, "name string, source_type string, fetch_type string, enabled boolean, max_entries int")
    raw = [(100 * k + i, n) for k, n in enumerate(["feed", "site", "named", "shut", "unknown"]) for i in range(30)]
    path = write(spark, tmp_path, "raw_candidates", raw, "rec_id long, source string")
    assert equals_sql(spark, path, "q35_source_cap", "sources", "raw_candidates") == 2 + 3 + 25


def records(seed, days, n=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 8)))
        rows.append(candidate(i, date(2026, 1, 1) + timedelta(days=i % days), title, rng.choice([None, f"https://e.example/{rng.randrange(90)}"]), rng.choice(["A", "B", None]), score=float(rng.randrange(50))))
    return rows


def test_q36_pairs_by_no_event_key(spark, tmp_path):
    rows = [*records(36, 2), candidate(900, date(2026, 1, 1), "News of the grid", source="X"), candidate(901, date(2026, 1, 1), "Power cut hits a grid", source="Y")]
    path = write(spark, tmp_path, "candidates", rows, CANDIDATES)
    assert equals_sql(spark, path, "q36_same_event_pairs", "candidates") < QUERIES["q79_event_pairs_every_rule"](spark, path).count()


def test_q37_checks_the_audit_lists(spark, tmp_path):
    rows = [*records(37, 3, 390), candidate(900, date(2026, 1, 1), "All about a grid", score=99.0), candidate(901, date(2026, 1, 2), "News of the grid", score=-1.0)]
    path = write(spark, tmp_path, "candidates", rows, CANDIDATES)
    assert equals_sql(spark, path, "q37_history_repeats", "candidates") < QUERIES["q80_history_repeats_of_all"](spark, path).count()


def test_q48_has_two_gates(spark, tmp_path):
    day, text = date(2026, 6, 10), "A language model for everybody, with benchmark results."
    good = lambda i, url, **k: candidate(i, day, k.pop("title", f"Title {i}"), url, **{"published_at": datetime(2026, 6, 9), "text": text} | k)
    rows = [
        good(1, "https://a.example/x"), good(2, "https://A.example/x"), good(3, "https://a.example/x/?utm_source=y"), good(4, "https://a.example/late", published_at=datetime(2025, 1, 1)), good(5, None), good(6, "", title="title 5"),
        good(7, "https://a.example/none", text="Nothing to the point is said here at all."), good(8, "https://a.example/de", text="é" * 300), good(9, "https://a.example/mesh", text="A mesh generator by hand, and a new turbine."), good(10, "u", title=None),
    ]
    path = write(spark, tmp_path, "candidates", rows, CANDIDATES)
    equals_sql(spark, path, "q48_run_log", "candidates")
    log = QUERIES["q48_run_log"](spark, path).first()
    assert (log["fetched"], log["filtered"], log["duplicates"]) == (10, 7, 2) and QUERIES["q81_run_log_all_gates"](spark, path).first()["filtered"] < 7
