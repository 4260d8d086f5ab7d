import random

from quillspan.operators import snapshots
from quillspan.operators.snapshots import snapshot_changes

SCHEMA = "ord long, d string, k string, a long, b long, _idx string, _chunk string"


def brute(rows):
    best = {}
    for o, d, k, a, b, *_ in rows:
        if d is not None and k is not None and (o, a is not None, a, b) and ((d, k) not in best or o > best[d, k][0]):
            best[d, k] = (o, a, b)
    days = sorted({d for d, _ in best})
    out = set()
    for was, now in zip(days, days[1:], strict=False):
        old = {k: v[1:] for (d, k), v in best.items() if d == was}
        new = {k: v[1:] for (d, k), v in best.items() if d == now}
        out |= {(now, k, "added") for k in new.keys() - old.keys()} | {(now, k, "removed") for k in old.keys() - new.keys()}
        out |= {(now, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in snapshot_changes(df, "d", "k", ["a", "b"], "ord").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_snapshots(spark):
    rng = random.Random(5)
    rows, o = [], 0
    state = {f"k{i:04d}": (rng.randrange(50), rng.choice([None, 1, 2])) for i in range(600)}
    for day in range(5):
        for k in list(state):
            u = rng.random()
            if u < 0.02:
                del state[k]
            elif u < 0.06:
                state[k] = (rng.choice([None, rng.randrange(50)]), rng.choice([None, 1, 2]))
        for i in range(10):
            state[f"n{day}_{i}"] = (i, None)
        for k, (a, b) in state.items():
            for _ in range(1 + (rng.random() < 0.1)):
                o += 1
                rows.append((o, f"2026-01-{day + 1:02d}", k, a if rng.random() > 0.05 else a, b, "x", None))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_nulls_late_rows_and_repeats(spark):
    rows = [
        (1, "2026-01-01", "a", None, 1, None, "c"), (2, "2026-01-08", "a", None, 1, None, "c"), (3, "2026-01-08", "b", 1, 1, None, "c"),
        (9, "2026-01-01", "b", 1, None, None, "c"), (4, "2026-01-01", "b", 7, 7, None, "c"), (5, None, "z", 1, 1, None, None), (6, "2026-01-01", None, 1, 1, None, None),
        (1, "2026-01-01", "a", None, 1, None, "c"), (7, "2026-01-15", "a", 0, 1, None, "c"),
    ]
    assert run(spark, rows) == {("2026-01-08", "b", "changed"), ("2026-01-15", "a", "changed"), ("2026-01-15", "b", "removed")}


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, "2026-01-01", "a", 1, 1, None, None)]) == set()


def test_equal_chunks_are_dropped_before_the_join(spark):
    """Same rows in both snapshots: chunk digests agree and no row reaches the join."""
    rows = [(i, d, f"k{i:05d}", i, i, None, None) for d in ("2026-01-01", "2026-01-02") for i in range(2000)]
    assert run(spark, rows) == set()
    assert snapshots.CHUNK_ROWS > 1


def test_hot_key(spark):
    rows = [(i, "2026-01-01", "hot", i, None, None, None) for i in range(3000)] + [(9999, "2026-01-02", "hot", 2999, None, None, None), (3, "2026-01-02", "cold", 1, 1, None, None)]
    assert run(spark, rows) == {("2026-01-02", "cold", "added")}
