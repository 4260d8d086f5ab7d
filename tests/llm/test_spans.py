import random

import numpy as np
import pytest

from quillspan.llm import spans
from quillspan.llm.blobs import Rolling, deltas, pack, undelta, unpack
from quillspan.llm.spans import DIFFERENCE_SETS, shared_spans


def brute(rows, length):
    texts = {i: t for i, t in rows if i is not None and t is not None}
    have = {}
    for i, t in texts.items():
        for k in range(len(t) - length + 1):
            have.setdefault(t[k : k + length], set()).add(i)
    out = set()
    for i, t in texts.items():
        mark = np.zeros(len(t) + 2, dtype=int)
        for k in range(len(t) - length + 1):
            if len(have[t[k : k + length]]) > 1:
                mark[k] += 1
                mark[k + length] -= 1
        on = np.cumsum(mark) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(int), [0]))))
        out |= {(i, int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)}
    return out


def run(spark, rows, length):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, runs string").repartition(3)
    got = [tuple(r) for r in shared_spans(df, "doc_id", "text", length).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_difference_sets_cover_all_shifts():
    for v, members in DIFFERENCE_SETS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))


@pytest.mark.parametrize("length", [6, 13, 40, 200])
def test_planted_passages(spark, length):
    rng = random.Random(length)
    letters = "abcdefgh äé中文😀\n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randrange(length - 3, 3 * length)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            if rng.random() < 0.5:
                k = rng.randrange(len(s))
                s = s[k:] if rng.random() < 0.5 else s[: k + 1]
            parts += [word(rng.randrange(0, length)), s]
        rows.append((i, "".join(parts)))
    assert run(spark, rows, length) == brute(rows, length)


def test_repeats_copies_nulls_and_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000))
    rows = [(1, "ab" * 500), (2, None), (3, ""), (4, "x" * 199), (None, "ab" * 500), (5, long), (6, "q" + long[30_000:30_450] + "z"), (7, "same text " * 40), (8, "same text " * 40), (8, "same text " * 40)]
    got = run(spark, rows, 200)
    assert got == brute(rows, 200)
    assert (6, 1, 451) in got and not any(i == 1 for i, _, _ in got)  # a run repeated in one record only isn't shared


def test_many_records_with_one_passage(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    p = word(260)
    rows = [(i, word(50) + p + word(50)) if i % 3 == 0 else (i, word(300)) for i in range(600)]
    assert run(spark, rows, 200) == brute(rows, 200)


def test_empty_table(spark):
    assert run(spark, [], 200) == set()


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    for a in (np.zeros(0, np.int64), np.arange(1000), rng.integers(-(2**62), 2**62, 500), np.array([5], np.int64)):
        b = unpack(pack(deltas(a), a.astype(np.uint32), a.astype(np.uint8)))
        assert (undelta(b[0]) == a).all() and (b[1] == a.astype(np.uint32)).all() and (b[2] == a.astype(np.uint8)).all()


def test_rolling_hash_depends_on_the_window_only():
    x = np.array([ord(c) for c in "abcabcabcdabc" * 50], dtype=np.uint32)
    r = Rolling(x)
    h = r.at(np.arange(len(x) - 4), 5)
    seen = {}
    for k in range(len(x) - 4):
        seen.setdefault(tuple(x[k : k + 5]), set()).add(int(h[k]))
    assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
    assert spans._window_min(np.array([5, 3, 4, 1, 2, 9]), 3).tolist() == [3, 1, 1, 1]


def test_hashes_that_collide_are_told_apart():
    import numpy as np

    from quillspan.llm.spans import _equal

    h, check = np.array([5, 5, 5, 7, 5], dtype=np.uint64), np.array([1, 2, 1, 1, 2], dtype=np.uint32)
    order, first = _equal(h, check)
    assert [sorted(g.tolist()) for g in np.split(order, first[1:])] == [[0, 2], [1, 4], [3]]
    order, first = _equal(h, None)
    assert [sorted(g.tolist()) for g in np.split(order, first[1:])] == [[0, 1, 2, 4], [3]]
