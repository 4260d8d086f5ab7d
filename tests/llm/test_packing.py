import random

import pytest

from quillspan.llm.packing import pack
from quillspan.llm.tokens import TOKENIZER, encoder, token_sizes

PROFILES = [("short", 50), ("long", 400)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 3) for r in rows], "i long, n long, profile string, container int")


def check(rows, out, profiles):
    sizes = [(i, n) for i, n in rows if i is not None and n is not None]
    for profile, capacity in profiles:
        mine = [r for r in out if r["profile"] == profile]
        full, pieces = {}, {}
        for r in mine:
            full[r["container"]] = full.get(r["container"], 0) + r["n_tokens"]
            pieces.setdefault(r["i"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
        assert all(v <= capacity for v in full.values())
        assert sum(full.values()) == sum(n for _, n in sizes)
        assert len(mine) == sum(max(1, -(-n // capacity)) for _, n in sizes)
        for i, n in sizes:
            if [x for x, _ in sizes].count(i) == 1:
                at = 0
                for k, (piece, first, m) in enumerate(sorted(pieces[i])):
                    assert (piece, first) == (k, at)
                    at += m
                assert at == n
    return full


def test_items_are_whole_and_containers_full(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([rng.randrange(60), rng.randrange(400), rng.randrange(2000)])) for i in range(5000)]
    out = pack(frame(spark, rows).repartition(4), "i", "n", PROFILES).collect()
    check(rows, out, PROFILES)
    for profile, capacity in PROFILES:
        mine = [r for r in out if r["profile"] == profile]
        assert sum(n for _, n in rows) / (len({r["container"] for r in mine}) * capacity) > 0.93


def test_edges(spark):
    rows = [(1, 0), (2, 50), (3, 51), (4, None), (None, 7), (5, 400), (6, 1201), (7, 3), (7, 3)] + [(100 + i, 0) for i in range(5000)]
    out = pack(frame(spark, rows), "i", "n", PROFILES).collect()
    check(rows, out, PROFILES)
    assert pack(frame(spark, []), "i", "n", PROFILES).collect() == []
    assert pack(frame(spark, rows), "i", "n", []).collect() == []
    with pytest.raises(ValueError):
        pack(frame(spark, rows), "i", "n", [("none", 0)])


def test_token_sizes_equal_the_tokenizer(spark):
    pytest.importorskip("tiktoken")
    texts = ["", "hello world", None, "<|endoftext|> is text", "Zürich 中文 😀" * 50, "a" * 5000]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "i int, t string, n_tokens int")
    got = {r["i"]: r["n_tokens"] for r in token_sizes(df, "t").collect()}
    e = encoder(TOKENIZER)
    assert got == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts) if t is not None}
    assert e.decode(e.encode_ordinary(texts[4])) == texts[4]


def test_no_cap_on_items(spark):
    """Ten thousand items of size 1 fill a container and begin a second."""
    rows = [(i, 1) for i in range(10_000)]
    out = pack(frame(spark, rows).coalesce(1), "i", "n", [("wide", 8192)]).collect()
    assert sorted(check(rows, out, [("wide", 8192)]).values()) == [1808, 8192]


def test_windows_passed_on_in_pieces_take_leftovers_in(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 2, 30, 399])) for i in range(3000)]
    out = pack(frame(spark, rows).repartition(6), "i", "n", PROFILES, held_items=5).collect()
    check(rows, out, PROFILES)
    assert sum(n for _, n in rows) / (len({r["container"] for r in out if r["profile"] == "long"}) * 400) > 0.98
