import random
import re
from datetime import datetime, timedelta

import pytest

from quillspan.llm import history
from quillspan.llm.history import Segment, _bounds, page_key, repeats_of_history

T0 = datetime(2026, 1, 1)


def brute(rows):
    """Every record against every accepted one."""
    accepted, out = [], set()
    first = min((b for b, r, *_ in rows if b is not None and r is not None), default=None)
    seen = set()
    for b, r, t, u, at in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[:2]):
        if r in seen:
            continue
        seen.add(r)
        words, numbers, page = set(re.findall("[a-z0-9]+", (t or "").lower())), set(re.findall("[0-9]+", t or "")), page_key(u)
        like = None
        if b != first:
            for r2, w2, n2, p2, at2 in accepted:
                if (page and page == p2) or (at and at2 and abs(at - at2) <= timedelta(hours=72) and numbers == n2 and words and w2 and 10 * len(words & w2) >= 7 * len(words | w2)):
                    like = r2
                    break
        if like is None:
            accepted.append((r, words, numbers, page, at))
        else:
            out.add((like, r))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "b int, r long, t string, u string, at timestamp, n int, shard string")
    got = [tuple(x) for x in repeats_of_history(df, "b", "r", "t", "u", "at").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("http://www.A.example/x/?b=2&a=1", "https://a.example/x?a=1&b=2#top"),
        ("https://a.example/x?utm_source=q&ref=z&id=3", "https://a.example/x?id=3&fbclid=7&gclid=&mc_cid=1&mc_eid=2"),
        ("https://a.example", "http://www.a.example/"),
    ],
)
def test_same_page(a, b):
    assert page_key(a) == page_key(b)


def test_other_pages():
    keys = [page_key(u) for u in ("https://a.example/x", "https://a.example/X", "https://b.a.example/x", "https://a.example/x?id=1", "https://a.example/x?id=2", "https://a.example/x?id=1&id=1")]
    assert len(set(keys)) == len(keys) and page_key(None) is None and page_key(" ") is None


def test_segment_finds_its_suffixes():
    import numpy as np

    texts = ["1\x012\x01ab cd ", "1\x012\x01abc ", "1\x012\x01ab ", "\x02a/b?", "\x02a/b?c", "1\x013\x01ab "]
    z = np.arange(len(texts))
    s = Segment.read(Segment.of(texts, z, z, z.astype(np.int32), z).blob())
    assert [s.texts[k] for k in range(*s.find(*_bounds("1\x012\x01ab zz ")))] == ["1\x012\x01ab ", "1\x012\x01ab cd "]
    assert [s.texts[k] for k in range(*s.find(*_bounds("\x02a/b?")))] == ["\x02a/b?"]
    lo, hi = s.find(*_bounds("1\x014\x01ab "))
    assert lo == hi


def test_random_batches(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of", "new", "7", "12"]
    rows, r = [], 0
    for b in range(4):
        for _ in range(250 if b == 0 else 80):
            r += 1
            if rows and b and rng.random() < 0.5:
                _, _, t, u, at = rng.choice(rows)
                w = (t or "").split()
                if w and rng.random() < 0.6:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
                    rng.shuffle(w)
                t = " ".join(w)
                at = at and at + timedelta(hours=rng.randrange(-100, 100))
                u = rng.choice([u, None, (u or "https://h.example/q") + "#x"])
            else:
                t = rng.choice([None, "", *[" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for _ in range(8)]])
                u = rng.choice([None, "", f"https://h.example/p{rng.randrange(400)}?id={r % 50}"])
                at = rng.choice([None, *[T0 + timedelta(hours=rng.randrange(2000))] * 4])
            rows.append((b, r, t, u, at))
    rows += [rows[300], rows[301], (None, 5000, "x", None, None), (2, None, "x", None, None)]
    assert run(spark, rows) == brute(rows)


def test_chain_and_crowd(spark, monkeypatch):
    """b repeats a, c is like b only and so accepted, d repeats c; and a third of a batch repeats one record."""
    t = lambda h: T0 + timedelta(hours=h)
    rows = [
        (0, 1, "alpha beta gamma delta", None, t(0)), (1, 2, "alpha beta gamma delta", None, t(70)), (1, 3, "alpha beta gamma delta", None, t(140)), (1, 4, "alpha beta gamma delta", None, t(200)),
        (1, 5, "alpha beta gamma delta 1", None, t(70)),
    ] + [(2, 100 + i, "alpha beta gamma delta", "https://x.example/1" if i % 2 else None, t(1)) for i in range(300)] + [(2, 1000 + i, f"solo{i} item{i}", None, t(1)) for i in range(300)]
    expected = brute(rows)
    assert (1, 2) in expected and (3, 4) in expected
    assert run(spark, rows) == expected
    monkeypatch.setattr(history, "TASK_QUERIES", 50)
    monkeypatch.setattr(history, "STEP_ROWS", 200)
    assert run(spark, rows) == expected


def test_empty_one_batch_and_long_title(spark):
    assert run(spark, []) == set()
    assert run(spark, [(0, 1, "a b", None, T0), (0, 2, "a b", None, T0)]) == set()
    long = " ".join(f"w{k}" for k in range(3000))
    assert run(spark, [(0, 1, long, None, T0), (1, 2, long + " x", None, T0)]) == {(1, 2)}


def read_back(spark, tmp_path, rows):
    """As run(), from a file, so that Spark knows sizes and shards hold many records."""
    path = str(tmp_path / "in.parquet")
    spark.createDataFrame(rows, "b int, r long, t string, u string, at timestamp").coalesce(2).write.mode("overwrite").parquet(path)
    return {tuple(x) for x in repeats_of_history(spark.read.parquet(path), "b", "r", "t", "u", "at").collect()}


def test_many_shards_and_salts(spark, tmp_path, monkeypatch):
    """Shards and salts of few records, whose spans one title's words crowd; long titles among them."""
    monkeypatch.setattr(history, "SHARD_ROWS", 40)
    monkeypatch.setattr(history, "SALT_ROWS", 100)
    monkeypatch.setattr(history, "LIKES", 2)
    rng = random.Random(3)
    common = ["w" + c for c in "abcdefghijklmn"]  # no digits: numbers must agree
    rows = []
    for r in range(900):
        words = rng.sample(common, rng.randrange(3, 12)) + ([f"x{'uvwxyz'[rng.randrange(6)]}"] if r % 3 == 0 else ["same"])
        if r % 50 == 0:
            words += ["long" + "i" * k for k in range(rng.randrange(30, 40))]
        rows.append((r // 300, r, " ".join(words), None, T0 + timedelta(hours=rng.randrange(400))))
    expected = brute(rows)
    assert len(expected) > 20
    assert read_back(spark, tmp_path, rows) == expected


def test_chain_of_two_thousand(spark, tmp_path):
    """Each record of one batch is like the one before it and no other: every second one repeats."""
    rows = [(0, 0, "something else", None, T0)] + [(1, 1 + k, "alpha beta gamma delta", None, T0 + timedelta(hours=71 * k)) for k in range(2000)]
    assert read_back(spark, tmp_path, rows) == {(k, k + 1) for k in range(1, 2000, 2)}


def test_line_ends_and_zeros_in_texts(spark, tmp_path):
    odd = ["a.example/bb\ncc", "a.example/bb\rcc", "a.example/bb\x00cc", "a.example/\x02", "a.example/\x01?x=\n"]
    rows = [(0, k, f"first\nline\x00{k} word\rhere", f"https://{u}", T0) for k, u in enumerate(odd * 8)]
    rows = [(b, r, t, u if r < len(odd) else u + str(r), at) for b, r, t, u, at in rows]
    rows += [(1, 100 + k, None, f"http://www.{u}", None) for k, u in enumerate(odd)] + [(1, 200, "first line 3 word here", None, T0)]
    assert read_back(spark, tmp_path, rows) == brute(rows)
    assert {(0, 100), (1, 101), (2, 102), (3, 103), (4, 104)} <= brute(rows)


def test_suffix_array_is_sorted_and_finds_the_longest_match():
    import numpy as np

    from quillspan.llm.suffixes import Index, Titles

    rng = random.Random(9)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(200)]

    def titles(texts):
        size = np.array([len(t) for t in texts])
        z = np.zeros(len(texts), np.int64)
        start = np.cumsum(size) - size
        words = np.array([w for t in texts for w in t], dtype=np.uint64)
        return Titles(z, np.arange(len(texts)), z, z.astype(np.uint64), size, words, np.arange(len(words)), np.repeat(np.arange(len(texts)), size)), start

    t, start = titles(texts)
    s = Titles.read(t.sorted().pack())
    symbols, ends = s.symbols(), s.ends()
    suffixes = [tuple(symbols[a : ends[r]].tolist()) for a, r in zip(s.seed, s.seed_of, strict=True)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(map(len, texts))
    q, _ = titles([[rng.randrange(4) for _ in range(8)] for _ in range(50)])
    index = Index(s)
    here, lo, hi = index.intervals(q, q.symbols())
    found = index.longest(q, q.symbols(), here, lo, hi)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for k, f in zip(here, found, strict=True):
        asked = tuple(q.symbols()[q.seed[k] : q.ends()[q.seed_of[k]]].tolist())
        assert shared(asked, suffixes[f]) == max(shared(asked, x) for x in suffixes)
