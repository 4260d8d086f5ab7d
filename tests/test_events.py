import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from quillspan.operators import events as ev
from quillspan.operators.dedup import first_rows, first_wins, last_wins, merge_sources
from quillspan.operators.publish import calendar_pages, duplicate_problems, published_index, quality_problems
from quillspan.operators.selection import Pass, select_greedily

VOCABULARY = "turbine mesh agent model solver launch partner city price cloud chip battery sensor robot lab grid data code health model".split()


def items(spark, n, seed, days=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 8)))
        rows.append((i, date(2026, 1, 1) + timedelta(days=rng.randrange(days)), title or None, rng.choice([None, "", f"https://e.example/{rng.randrange(n)}?x={i}"]), rng.choice(["A", "a", "B", None])))
    df = spark.createDataFrame(rows, "id long, day date, title string, url string, source string")
    return ev.event_columns(df, "title", "url", "source", [("grid", [["grid"], ["code"]])])


def test_blocked_pairs_equal_all_pairs(spark):
    for variant in (ev.BUILDER, ev.RENDERER, ev.SUMMARISER):
        df = items(spark, 150, 1)
        if variant.url == "shown":
            df = ev.event_columns(df.select("id", "day", "title", "url", "source"), "title", "url", "source", variant=variant)
        a, b = df.alias("a"), df.alias("b")
        plain = a.join(b, (F.col("a.id") < F.col("b.id")) & (F.col("a.day") == F.col("b.day")) & ev.same_event("a", "b", variant)).select("a.id", "b.id")
        got = ev.same_event_pairs(df, "id", ["day"], variant).select("left", "right")
        expected = {tuple(r) for r in plain.collect()}
        assert {tuple(r) for r in got.collect()} == expected and expected


def test_repeats_of_history(spark):
    df = items(spark, 200, 2, days=12).cache()
    a, b = df.alias("a"), df.alias("b")
    near = (F.col("b.day") < F.col("a.day")) & (F.col("b.day") >= F.date_sub("a.day", 3))
    plain = a.join(b, near & ev.same_event("a", "b")).groupBy("a.id").agg(F.min("b.id"))
    expected = {tuple(r) for r in plain.collect()}
    assert {tuple(r) for r in ev.repeats_of(df, df, "id", "day", 3).collect()} == expected and expected
    assert {r["id"] for r in ev.without_repeats(df, df, "id", "day", 3).collect()} == set(range(200)) - {i for i, _ in expected}


def test_similar_titles_of_one_source_and_tracking(spark):
    rows = [(1, "sqlite-utils 4.0 released with fixes", "https://a.example/1?utm_source=x", "Blog"), (2, "sqlite-utils 0.2 released", "https://a.example/2", "blog"), (3, "Other", "https://A.example/1", "Wire")]
    df = ev.event_columns(spark.createDataFrame(rows, "id long, title string, url string, source string"), "title", "url", "source")
    assert {tuple(r) for r in ev.same_event_pairs(df, "id").collect()} == {(1, 2), (1, 3)}


def alike(a, b):
    if a["_url"] and a["_url"] == b["_url"] or a["_key"] and a["_key"] == b["_key"]:
        return True
    x, y = set(a["_tok"]), set(b["_tok"])
    n = len(x & y)
    s, u = min(len(x), len(y)), len(x | y)
    return n > 0 and ((n >= 5 and n >= 0.5 * s) or (n >= 4 and n >= 0.42 * u) or (a["_src"] == b["_src"] and n >= 2 and n >= 0.67 * s))


def fold(rows, passes, limit):
    taken, tally = [], {}
    for p in passes:
        for r in rows:
            if len(taken) == limit:
                break
            if r in taken or not r[p.admit] or any(r[c] is not None and tally.get((c, r[c]), 0) >= m for c, m in p.caps.items()) or any(alike(r, t) for t in taken):
                continue
            taken.append(r)
            for c in p.counts:
                tally[c, r[c]] = tally.get((c, r[c]), 0) + 1
    return [r["id"] for r in taken]


def test_selection_equals_a_plain_fold(spark):
    for seed in range(4):
        df = items(spark, 300, 10 + seed).withColumns({
            "score": F.pmod(F.xxhash64("id"), F.lit(20)).cast("double"), "topic": F.concat(F.lit("t"), (F.col("id") % 4).cast("string")),
            "broad": F.when(F.col("id") % 3 == 0, "broad"), "good": F.col("id") % 2 == 0, "any": F.lit(True),
        }).cache()
        passes = [Pass("good", {"topic": 1, "_src": 2}, ("topic", "_src")), Pass("any", {"_src": 3, "broad": 1}, ("_src", "broad")), Pass("any", {"broad": 2}, ("broad",))]
        got = {}
        for r in select_greedily(df, ["day"], "id", ["-score", "id"], passes, 9).collect():
            got.setdefault(r["day"], {})[r["place"]] = r["id"]
        rows = {}
        for r in df.collect():
            rows.setdefault(r["day"], []).append(r.asDict())
        for day, mine in rows.items():
            mine.sort(key=lambda r: (-r["score"], r["id"]))
            assert [got[day][k] for k in sorted(got[day])] == fold(mine, passes, 9)


def test_published_index_repeats_nothing_of_the_week_before(spark):
    df = items(spark, 120, 30, days=9).withColumn("any", F.lit(True)).cache()
    passes = [Pass("any")]
    out = published_index(df, "day", "id", lambda d: select_greedily(d, ["day"], "id", ["id"], passes, 3), 3).collect()
    by_day = {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        by_day.setdefault(r["day"], []).append(r.asDict())
    published = {}
    for day in sorted(by_day):
        past = [x for d, l in published.items() if 0 < (day - d).days <= 3 for x in l]
        free = [r for r in by_day[day] if not any(alike(r, p) for p in past)]
        chosen = fold(free, passes, 3)
        published[day] = [r for i in chosen for r in free if r["id"] == i]
    assert {(r["day"], r["id"], r["place"]) for r in out} == {(d, r["id"], k) for d, l in published.items() for k, r in enumerate(l, 1)}


def test_gates_and_calendar(spark):
    rows = [("2026-01-01", "a")] * 3 + [("2026-01-01", "b")] + [("2026-01-10", "b")] * 9
    df = spark.createDataFrame(rows, "d string, s string")
    got = {tuple(r) for r in quality_problems(df, "d", "s", {"a": 2, "b": 2}, 5).collect()}
    assert got == {("2026-01-01", "b has 1 of 2"), ("2026-01-01", "issue has 4 of 5"), ("2026-01-10", "a has 0 of 2")}
    pages = {str(r["day"]): (r["records"], r["page"]) for r in calendar_pages(df, "d").collect()}
    assert len(pages) == 10 and pages["2026-01-10"] == (9, 1) and pages["2026-01-03"] == (0, 2)
    assert calendar_pages(df.limit(0), "d").collect() == []
    kinds = {r["kind"] for r in duplicate_problems(items(spark, 80, 3), "id", "day", 3).collect()}
    assert kinds == {"issue", "history"}


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y"), (4, None, "z")], "o long, k string, v string")
    assert {tuple(r) for r in first_wins(df, [F.col("k")], ["o"]).collect()} == {(1, "a", None), (3, None, "y")}
    assert {tuple(r) for r in last_wins(df, [F.col("k")], ["o"]).collect()} == {(2, "a", "x"), (4, None, "z")}
    assert {(r["k"], r["o"]) for r in first_rows(df.where("k IS NOT NULL"), ["k"], [F.col("o").desc()], 1).collect()} == {("a", 2)}
    more = spark.createDataFrame([(9, "a", "late"), (8, "c", "new")], "o long, k string, v string")
    assert {tuple(r) for r in merge_sources([last_wins(df.where("k = 'a'"), [F.col("k")], ["o"]), more], F.col("k"), [F.col("o")]).collect()} == {(2, "a", "x"), (8, "c", "new")}
