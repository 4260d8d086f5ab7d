"""Sections of an issue against plain folds written from their rules, and on small made issues."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import events as ev
from quillspan.operators import sections as se
from quillspan.operators.publish import issue_problems, latest_reports, told_before
from test_events import VOCABULARY, alike

SCHEMA = "day int, id long, title string, url string, source string, category string, preferred boolean, trusted boolean, broad string, topic string, origin string, about boolean, score double"
ISSUE = se.Issue(("day",), "id", ("-score", "id"))


def record(i, title, category="general_ai", source=None, topic=None, preferred=True, trusted=True, broad=None, about=False, score=None, day=1, url=None):
    source = source or f"S{i}"
    return (day, i, title, url or f"https://e.example/{i}", source, category, preferred, trusted, broad, topic or f"t{i}", source, about, 100.0 - i if score is None else score)


def frame(spark, rows):
    return ev.event_columns(spark.createDataFrame(rows, SCHEMA), "title", "url", "source")


def random_rows(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(3, 8))) + f" u{rng.randrange(10**6)} v{rng.randrange(10**6)}"
        broad = rng.random() < 0.4
        rows.append(record(
            i, title, rng.choice(["general_ai", "general_ai", "research", "engineering_ai"]), rng.choice("ABCDEFG"), rng.choice("xyz"), rng.random() < 0.3, not broad, "broad" if broad else None,
            rng.random() < 0.5, float(rng.randrange(40)), rng.randrange(2), f"https://e.example/{rng.randrange(n)}",
        ))
    return rows


def issues(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["day"], []).append(r.asDict())
    return {d: sorted(v, key=lambda r: (-r["score"], r["id"])) for d, v in by.items()}


def result(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["day"], {})[r["place"]] = r["id"]
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    return {d: [v[k] for k in sorted(v)] for d, v in by.items()}


def plain_draft(rows, section, limit, known=(), preferred=True):
    """The rule of the draft, written out."""
    capped = section in ("general_ai", "engineering_ai")
    most = {"general_ai": 2, "engineering_ai": 1}.get(section, limit)
    taken, topics, sources, broads = [], {}, {}, 0

    def fits(r):
        own = r["category"] == section or (section == "general_ai" and r["category"] == "research" and r["preferred"])
        return own and (section != "general_ai" or not preferred or r["preferred"])

    for turn in (1, 2, 3, 4):
        for r in rows:
            if len(taken) == limit:
                break
            if not fits(r) or r in taken or any(alike(r, x) for x in (*known, *taken)):
                continue
            if turn == 1 and capped and not r["trusted"]:
                continue
            if turn > 1 and capped and r["broad"] and broads >= most:
                continue
            if turn != 3 and topics.get(r["topic"], 0) >= 2:
                continue
            if (turn < 4 or capped) and sources.get(r["origin"], 0) >= most:
                continue
            taken.append(r)
            sources[r["origin"]] = sources.get(r["origin"], 0) + 1
            if turn != 3:
                topics[r["topic"]] = topics.get(r["topic"], 0) + 1
            if turn > 1 and r["broad"]:
                broads += 1
    if section == "general_ai" and preferred and len(taken) < limit:
        for r in plain_draft(rows, section, limit, known, False):
            if len(taken) < limit and not any(alike(r, x) for x in taken):
                taken.append(r)
    return taken


def plain_page(rows, section, limit, known=(), preferred=False):
    most = 1 if section == "engineering_ai" else 2
    taken, topics, sources = [], {}, {}
    for turn in (1, 2, 3):
        for r in rows:
            if len(taken) == limit:
                break
            own = r["category"] == section or (section == "general_ai" and r["category"] == "research" and r["preferred"])
            if not own or (preferred and not r["preferred"]) or r in taken or any(alike(r, x) for x in (*known, *taken)):
                continue
            if turn == 1 and topics.get(r["topic"], 0) >= 2:
                continue
            if (turn < 3 or section in ("general_ai", "engineering_ai")) and sources.get(r["origin"], 0) >= most:
                continue
            taken.append(r)
            sources[r["origin"]] = sources.get(r["origin"], 0) + 1
            if turn == 1:
                topics[r["topic"]] = topics.get(r["topic"], 0) + 1
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sections_equal_plain_folds(spark, seed):
    df = frame(spark, random_rows(seed)).cache()
    by = issues(df)
    past = df.where("id % 29 = 0")
    told = {d: [r for r in v if r["id"] % 29 == 0] for d, v in by.items()}
    for section, limit in (("general_ai", 10), ("engineering_ai", 5), ("research", 12)):
        got = result(se.draft_section(df, ISSUE.knowing(past), section, limit))
        assert got == {d: [r["id"] for r in plain_draft(v, section, limit, told[d])] for d, v in by.items()}
        got = result(se.page_section(df, ISSUE.knowing(past), section, limit, variant=ev.BUILDER))
        assert got == {d: [r["id"] for r in plain_page(v, section, limit, told[d])] for d, v in by.items()}
    listed = df.where("preferred AND day = 0")
    got = result(se.page_section(df, ISSUE, "general_ai", 6, listed, variant=ev.BUILDER))
    for d, v in by.items():
        first = plain_page(v, "general_ai", 6, preferred=d == 0)
        assert got[d] == [r["id"] for r in (first if len(first) == 6 else plain_page(v, "general_ai", 6))]


def test_day_tells_of_nothing_twice_and_fills_short_sections(spark):
    df = frame(spark, random_rows(9)).cache()
    pick = {"general_ai": se.draft_section(df, ISSUE, "general_ai", 10), "engineering_ai": se.draft_section(df, ISSUE, "engineering_ai", 5), "topic": se.draft_topic_section(df, ISSUE, F.col("about"), 5), "research": se.draft_section(df, ISSUE, "research", 5)}
    listed = {k: df.join(v, ["day", "id"]) for k, v in pick.items()}
    audit = df.where("score >= 20")
    out = se.day_sections(audit, listed, ISSUE, F.col("about"), variant=ev.BUILDER).collect()
    rows = {r["id"]: r.asDict() for r in df.collect()}
    for d in (0, 1):
        mine = [rows[r["id"]] for r in out if r["day"] == d]
        assert len(mine) > 10
        assert not any(alike(a, b) for k, a in enumerate(mine) for b in mine[k + 1 :])
        known = []
        for section, limit in (("general_ai", 10), ("engineering_ai", 5)):
            got = [rows[r["id"]] for r in sorted((r for r in out if r["day"] == d and r["section"] == section), key=lambda r: r["place"])]
            if section == "engineering_ai":
                base = plain_page([r for r in issues(audit)[d]], section, limit, known)
                assert got[: len(base)] == base and len(got) <= limit
            known += got


def names(df):
    return result(df).get(1, [])


def test_topics_are_spread(spark):
    rows = [record(i, f"Agents word{i} item{i}", topic="agents") for i in range(3)] + [record(5, "Chip price falls", topic="chips")]
    assert names(se.draft_section(frame(spark, rows), ISSUE, "general_ai", 3)) == [0, 1, 5]


def test_broad_discovery_and_sources_are_capped(spark):
    rows = [record(i, f"Story word{i} item{i}", source=f"News {i}", trusted=False, broad="broad") for i in range(4)] + [record(9, "Curated piece here", score=1.0)]
    assert names(se.draft_section(frame(spark, rows), ISSUE, "general_ai", 5)) == [9, 0, 1]
    rows = [record(i, f"Story word{i} item{i}", source="One") for i in range(4)] + [record(9, "Other piece here")]
    assert names(se.draft_section(frame(spark, rows), ISSUE, "general_ai", 5)) == [0, 1, 9]


def test_preferred_first_and_the_rest_after(spark):
    rows = [record(0, "Plain story alpha", preferred=False), record(1, "Preferred story beta"), record(2, "Preferred paper gamma", "research"), record(3, "Plain paper delta", "research", preferred=False)]
    assert names(se.draft_section(frame(spark, rows), ISSUE, "general_ai", 4)) == [1, 2, 0]


def test_engineering_takes_curated_records_first(spark):
    rows = [record(0, "Mesh story alpha", "engineering_ai", trusted=False, broad="broad"), record(1, "Mesh story beta", "engineering_ai"), record(2, "Solver news gamma", "engineering_ai", trusted=False, broad="broad")]
    assert names(se.draft_section(frame(spark, rows), ISSUE, "engineering_ai", 3)) == [1, 0]


def test_history_is_not_repeated(spark):
    rows = [record(0, "Solver release brings faster contact for large models"), record(1, "Something else entirely")]
    past = frame(spark, [record(50, "Solver release brings faster contact for large models today", day=0)])
    assert names(se.draft_section(frame(spark, rows), ISSUE.knowing(past.withColumn("day", F.lit(1))), "general_ai", 5)) == [1]
    days = told_before(spark.sql("SELECT DATE '2026-01-01' AS d, 7 AS x"), "d", 7).agg(F.min("d"), F.max("d"), F.count("*")).first()
    assert [str(x) for x in days] == ["2026-01-02", "2026-01-08", "7"]


def test_section_by_subject(spark):
    rows = [record(0, "Hospital model alpha", about=True), record(1, "Chip model beta"), record(2, "Clinic paper gamma", "research", about=True, trusted=False, broad="broad"), record(3, "Patient study delta", about=True, trusted=False, broad="broad"), record(4, "Mesh of a heart epsilon", "engineering_ai", about=True)]
    assert names(se.draft_topic_section(frame(spark, rows), ISSUE, F.col("about"), 5)) == [0, 2]


def test_summary_section_and_noise(spark):
    rows = [record(i, f"Mesh word{i} item{i}", "engineering_ai", topic="t") for i in range(4)] + [record(7, "Mesh pricing news", "engineering_ai")]
    noise = F.contains("title", F.lit("pricing"))
    assert names(se.summary_section(frame(spark, rows), ISSUE, "engineering_ai", 5, noise, ev.BUILDER)) == [0, 1, 2, 3]


def test_gate_finds_missing_issues_and_reports(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "day string")
    log = spark.createDataFrame([("a", 5, 9, 3, None), ("b", 0, 0, None, "A PLACEHOLDER run"), ("c", None, 0, 4, "")], "day string, source_count long, fetched_count long, candidates long, note string")
    got = {tuple(r) for r in issue_problems(expected, log, "day").collect()}
    assert got == {("b", "no source was loaded"), ("b", "nothing was fetched"), ("b", "a placeholder: A PLACEHOLDER run"), ("c", "no source was loaded"), ("d", "the issue is missing")}
    paths = spark.createDataFrame([("x/weekly/2026-01-04-trends.md",), ("x/weekly/2026-02-01-trends.md",), ("x/weekly/notes.md",), ("x/other/2026-03-01-trends.md",)], "path string")
    assert {tuple(r) for r in latest_reports(paths, "path", ["weekly", "monthly"], r"^\d{4}-\d{2}-\d{2}-trends\.md$").collect()} == {("weekly", "x/weekly/2026-02-01-trends.md"), ("monthly", None)}
