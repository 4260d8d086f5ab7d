"""Same-event pairs: what is moved for them, and crowded blocks, parts of groups, short and long titles against all pairs."""

import random
from datetime import date, timedelta

import pytest

from quillspan.operators import events as ev
from quillspan.operators import pairs
from quillspan.plans.catalogue import QUERIES
from test_events import alike

PHRASES = ["heat exchanger siting", "air traffic control room", "power electronics", "week pilot after customer", "despite open questions", "railway timetables", "metal forming press line", "drug discovery"]


def shuffled(spark):
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def titles(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            t = f"{rng.choice(PHRASES)} {rng.choice(PHRASES)} {rng.choice(PHRASES)} name{rng.randrange(n)}"
        elif kind < 0.9:
            t = " ".join(rng.choice(" ".join(PHRASES).split()) for _ in range(rng.randrange(0, 7)))
        else:
            t = " ".join(f"word{rng.randrange(90)}" for _ in range(rng.choice([60, 100])))
        out.append((i, date(2026, 1, 1) + timedelta(days=rng.choice([0, 0, 0, 1])), t, rng.choice([None, "", f"https://e.example/{rng.randrange(n // 2)}"]), rng.choice(["A", "a", "B", None, f"S{i}"])))
    return out


@pytest.mark.parametrize("divided", [pairs.DIVIDED, 40])
@pytest.mark.parametrize("ranked", [pairs.RANKED, 6])
def test_pairs_equal_all_pairs_in_crowded_blocks(spark, monkeypatch, divided, ranked):
    monkeypatch.setattr(pairs, "DIVIDED", divided)
    monkeypatch.setattr(pairs, "RANKED", ranked)
    df = spark.createDataFrame(titles(500, divided + ranked), "id long, day date, title string, url string, source string")
    df = ev.event_columns(df, "title", "url", "source", [("drug", [["drug"]])]).cache()
    rows = [r.asDict() for r in df.collect()]
    expected = {(a["day"], a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and a["day"] == b["day"] and alike(a, b)}
    got = [tuple(r) for r in ev.same_event_pairs(df, "id", ["day"]).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 3000


def test_pairs_without_a_group_and_with_names_as_idents(spark):
    df = spark.createDataFrame([(f"n{i}", t, u, s) for i, _, t, u, s in titles(200, 3)], "id string, title string, url string, source string")
    for variant in (ev.BUILDER, ev.SUMMARISER):
        e = ev.event_columns(df, "title", "url", "source", [("drug", [["drug"]])], variant=variant).cache()
        rows = [r.asDict() | ({} if variant.same_source else {"_src": r["id"]}) for r in e.collect()]
        got = [tuple(r) for r in ev.same_event_pairs(e, "id", [], variant).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and alike(a, b)}
    assert ev.same_event_pairs(e.limit(0), "id", []).collect() == []


def test_pairs_move_few_rows_a_record(spark):
    rows = [(i, f"maker{i % 97} tests line{i % 89} solver{i % 83} for sensor{i % 79} after week{i % 73} pilot at plant{i % 71} near lake{i % 67} again", f"S{i % 50}") for i in range(2000)]
    df = ev.event_columns(spark.createDataFrame(rows, "id long, title string, source string").withColumn("url", ev.F.lit(None).cast("string")), "title", "url", "source")
    before = shuffled(spark)
    ev.same_event_pairs(df, "id").write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 6 * len(rows)


def test_q79_moves_few_rows_a_record(spark, data):
    n = spark.read.parquet(f"{data}/candidates.parquet").count()
    before = shuffled(spark)
    QUERIES["q79_event_pairs_every_rule"](spark, data).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 30 * n


def shuffled_bytes(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_pairs_move_few_bytes_a_record(spark):
    """Names and addresses that one record has aren't moved with it, frequent words are numbers of two bytes."""
    rng = random.Random(1)
    rows = [(i, " ".join([f"name{rng.getrandbits(60)}", *(f"word{rng.randrange(2000)}" for _ in range(9))]), f"https://e.example/{rng.getrandbits(60)}", f"S{i % 50}") for i in range(6000)]
    df = ev.event_columns(spark.createDataFrame(rows, "id long, title string, url string, source string"), "title", "url", "source")
    before = shuffled_bytes(spark)
    ev.same_event_pairs(df, "id").write.format("noop").mode("overwrite").save()
    assert shuffled_bytes(spark) - before < 170 * len(rows)


@pytest.mark.parametrize("cells", [pairs.CELLS, pairs.BITMAP])
def test_pairs_of_titles_with_words_of_their_own(spark, monkeypatch, cells):
    """Long titles of which few words are met elsewhere, short ones of their source, addresses met once; rows delivered twice; a full filter."""
    monkeypatch.setattr(pairs, "CELLS", cells)
    rng, rows = random.Random(cells), []
    for i in range(400):
        shared = rng.sample("heat exchanger siting traffic control power electronics week pilot customer".split(), rng.choice([0, 1, 2, 2, 3, 4, 5, 6]))
        own = [f"own{i}n{k}" for k in range(rng.choice([0, 0, 1, 2, 4, 7]))]
        rows.append((i, " ".join(shared + own), rng.choice([None, f"https://e.example/{i}", f"https://e.example/{rng.randrange(150)}"]), rng.choice("AB")))
    df = ev.event_columns(spark.createDataFrame(rows, "id long, title string, url string, source string"), "title", "url", "source").cache()
    known = [r.asDict() for r in df.collect()]
    expected = {(a["id"], b["id"]) for a in known for b in known if a["id"] < b["id"] and alike(a, b)}
    twice = df.union(df.where("id % 3 = 0"))
    for got in (ev.same_event_pairs(df, "id"), ev.same_event_pairs(twice, "id", once=False)):
        got = [tuple(r) for r in got.collect()]
        assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 1000
