import random

from quillspan.llm.radix import over_cap


def brute(rows, cap):
    groups = {}
    for c, i, s in rows:
        if c is not None and i is not None:
            groups.setdefault(c, []).append(((s is None or s != s, -(s if s is not None and s == s else 0.0), i), i))
    return {(c, i) for c, l in groups.items() for _, i in sorted(l)[max(0, cap.get(c) or 0) :]}


def run(spark, rows, cap):
    df = spark.createDataFrame([(c, i, s, cap.get(c), 7, "k", "r") for c, i, s in rows], "c string, i long, s double, cap long, _k1 long, _cut1 string, _row string")
    out = over_cap(df, ["c"], "s", "i", "cap")
    assert out.columns == df.columns
    got = [(r["c"], r["i"]) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random(spark):
    rng = random.Random(3)
    scores = [None, float("nan"), 0.0, -0.0, 1.5, -2.25, 63.881, 63.882, 1e300, -1e300, float("inf"), float("-inf")]
    for ids in (range(1000), range(-500, 500), [x << 40 for x in range(1000)]):
        rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice([*scores, rng.random() * 100])) for i in ids] + [("a", None, 1.0)]
        for cap in ({"a": 5, "b": 333, "c": 10**6}, {"a": 0, "b": None, "c": 1}, {"a": -4, "b": 17, "c": 100}):
            assert run(spark, rows, cap) == brute(rows, cap)


def test_all_scores_equal_and_hot_contributor(spark):
    rows = [("hot", i, 1.0) for i in range(3000)] + [(f"c{i % 50}", i, 1.0) for i in range(6000)]
    cap = {"hot": 40} | {f"c{i}": 3 for i in range(50)}
    assert run(spark, rows, cap) == brute(rows, cap)


def test_empty_one_row_and_exact_cap(spark):
    assert run(spark, [], {}) == set()
    assert run(spark, [("a", 1, None)], {"a": 1}) == set()
    assert run(spark, [("a", 1, None)], {"a": 0}) == {("a", 1)}
    assert run(spark, [("a", 1, 1.0), ("a", 2, 1.0)], {"a": 2}) == set()
