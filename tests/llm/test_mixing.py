import random

from quillspan.llm.mixing import mixture, running_total

DOCS, TARGETS = "i long, source string, n long, _key long, weight double", "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **k):
    d = spark.createDataFrame([(*x, 1, 0.5) for x in docs], DOCS).repartition(3)
    mix, shares = mixture(d, spark.createDataFrame(targets, TARGETS), "i", "source", "n", **k)
    return sorted((tuple(r) for r in mix.collect()), key=lambda r: (r[0], r[4])), {r["source"]: r.asDict() for r in shares.collect()}


def test_running_total_is_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "b", "c"]), k, rng.randrange(100)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    for groups in (["g"], []):
        got = {(r["g"], r["k"]): r["t"] for r in running_total(df, groups, ["k"], "v", "t").collect()}
        total = {}
        for g, k, v in sorted(rows, key=lambda r: r[1]):
            key = g if groups else ""
            total[key] = total.get(key, 0) + v
            assert got[g, k] == total[key]


def test_shares_repeats_and_order(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["big"] * 8 + ["small", "mid", "other", None]), rng.choice([None, *range(1, 60)])) for i in range(4000)] + [(9001, "big", 0)]
    targets = [("big", 0.5, 1), ("mid", 0.25, 2), ("small", 0.15, 4), ("none", 0.1, 3)]
    mix, shares = run(spark, docs, targets)
    total = sum(r[4] for r in mix)
    at = 0
    for offset, _, _, _, n in mix:
        assert offset == at
        at += n
    uses = {}
    for _, s, i, c, _ in mix:
        uses.setdefault((s, i), []).append(c)
    most = {s: m for s, _, m in targets}
    assert all(len(c) <= most[s] and sorted(c) == list(range(len(c))) for (s, _), c in uses.items())
    for s, want, _ in targets:
        got = shares[s]
        mine = sum(r[4] for r in mix if r[1] == s)
        assert got["n_tokens"] == mine and abs(got["actual_share"] - mine / total) < 1e-9
        assert got["actual_share"] == 0 if s == "none" else abs(got["actual_share"] - want / 0.9) < 0.01
    # at any point the mixture so far has the shares, up to a document of each source
    half = [r for r in mix if r[0] < total / 2]
    assert abs(sum(r[4] for r in half if r[1] == "big") - 0.5 / 0.9 * total / 2) <= 250


def test_budget_beyond_small_sources(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(5)]
    mix, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], budget=800)
    assert shares["b"]["n_tokens"] == 100 and shares["b"]["most_repeats"] == 2 and shares["a"]["n_tokens"] == 700
    mix, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)])
    assert sum(r[4] for r in mix) == 200


def test_empty(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == []
    mix, shares = run(spark, [(1, "a", 5)], [])
    assert mix == [] and shares == {}
    mix, shares = run(spark, [(1, "a", 5)], [("a", None, 1), ("b", 0.3, None)])
    assert mix == [] and shares["a"]["n_tokens"] == 0


def test_sources_of_two_documents_run_out_and_none_is_missing(spark):
    """With the size of all documents as budget, two small sources run out and all others hold their share of the rest."""
    rng = random.Random(5)
    docs = [(i, rng.choice(["big", "mid"]), rng.randrange(10, 200)) for i in range(2000)] + [(5000, "two", 90), (5001, "two", 700), (5002, "pair", 30), (5003, "pair", 40)]
    targets = [("big", 0.5, 2), ("mid", 0.4, 2), ("two", 0.04, 4), ("pair", 0.06, 3)]
    mix, shares = run(spark, docs, targets, budget="held")
    budget = sum(n for _, _, n in docs)
    total = sum(r[4] for r in mix)
    assert budget - 200 < total <= budget and {r["budget"] for r in shares.values()} == {budget}
    assert shares["two"]["n_tokens"] == shares["two"]["available_tokens"] == 3160 and shares["two"]["ran_out"]
    assert shares["pair"]["n_tokens"] == 210 and shares["pair"]["most_repeats"] == 3 and shares["pair"]["ran_out"]
    rest = budget - 3160 - 210
    for s, share in (("big", 5 / 9), ("mid", 4 / 9)):
        assert abs(shares[s]["n_tokens"] - share * rest) <= 400 and not shares[s]["ran_out"]


def test_budget_beyond_everything_takes_all(spark):
    mix, shares = run(spark, [(1, "a", 5), (2, "a", 6), (3, "b", 7)], [("a", 0.5, 2), ("b", 0.5, 1)], budget=1000)
    assert sum(r[4] for r in mix) == 29 and all(r["ran_out"] for r in shares.values())
