import random

from quillspan.llm.topn import top_n


def brute(rows, n):
    groups = {}
    for g, i, s, *_ in rows:
        if g is not None and i is not None:
            key = (s is None or s != s, -(s if s is not None and s == s else 0), i)
            d = groups.setdefault(g, {})
            d[i] = min(d.get(i, key), key)
    return {(g, i) for g, d in groups.items() for i in sorted(d, key=d.get)[:n]}


def run(spark, rows, n=3):
    df = spark.createDataFrame(rows, "g string, i long, s double, rank long, _salt string").repartition(5)
    return [(r["g"], r["i"]) for r in top_n(df, ["g"], "s", "i", n).collect()]


def test_random_groups_with_ties_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", "", None]), rng.choice([None, *range(200)]), rng.choice([None, float("nan"), 1.0, 2.0, 3.5, -0.0, 0.0, float("inf")]), 1, "x") for _ in range(3000)]
    rows += rows[:200]
    for n in (1, 3, 50):
        got = run(spark, rows, n)
        assert len(got) == len(set(got)) and set(got) == brute(rows, n)


def test_a_group_with_a_third_of_all_rows(spark):
    rows = [("hot", i, float(i % 7), 1, None) for i in range(4000)] + [(f"g{i}", i, 1.0, 1, None) for i in range(2000)]
    assert set(run(spark, rows, 10)) == brute(rows, 10)


def test_empty_and_no_rows_wanted(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", 1, 1.0, 1, "")], 0) == []


def test_stream_of_any_batches_passes_the_first_of_each_group():
    """Groups that lie in several batches, identifiers that recur beside each other and apart."""
    import pyarrow as pa

    from quillspan.llm.topn import _emit

    rng = random.Random(4)
    for _ in range(300):
        rows = [(g, rng.randrange(6)) for g in range(rng.randrange(1, 6)) for _ in range(rng.choice([1, 2, 9, 30]))]
        n = rng.randrange(1, 5)
        batches, k = [], 0
        while k < len(rows):
            step = rng.choice([0, 1, 2, 7, 40])
            part = rows[k : k + step]
            batches.append(pa.RecordBatch.from_pydict({"g": pa.array([g for g, _ in part], pa.int64()), "i": pa.array([i for _, i in part], pa.int64()), "at": pa.array(range(k, k + len(part)), pa.int64())}))
            k += len(part)
        got = [x for b in _emit(["g"], "i", n)(iter(batches)) for x in b.column("at").to_pylist()]
        want, seen = [], {}
        for at, (g, i) in enumerate(rows):
            mine = seen.setdefault(g, set())
            if len(mine) < n and i not in mine:
                mine.add(i)
                want.append(at)
        assert got == want
