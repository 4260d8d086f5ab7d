import random
import re

from quillspan.llm.neardup import near_duplicate_pairs, near_duplicates

W = re.compile("[a-z0-9]+")


def grams(title, text, run):
    w = W.findall(f"{title or ''} {text or ''}".lower())
    return set(zip(*(w[k:] for k in range(run)), strict=False))


def brute(rows, threshold, run):
    s = {i: grams(a, b, run) for i, a, b in rows if i is not None}
    ids = sorted(s)
    return {(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :] if s[x] and s[y] and len(s[x] & s[y]) >= threshold * len(s[x] | s[y])}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "i long, title string, text string, class string, a long")


def corpus(rng, n, edits):
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[2].split()
            for _ in range(rng.randrange(edits)):
                k = rng.randrange(len(w))
                u = rng.random()
                if u < 0.4:
                    w[k] = rng.choice(vocabulary)
                elif u < 0.7:
                    w.insert(k, rng.choice(vocabulary))
                elif len(w) > 12:
                    w[:] = w[k:] + w[:k] if u > 0.95 else w[:k] + w[k + 1 :]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 80))]
        rows.append((i, "", " ".join(w)))
    return rows


def test_no_pair_is_missed_or_made_up(spark):
    rows = corpus(random.Random(4), 500, 8)
    for threshold, run in ((0.5, 3), (0.8, 5)):
        got = [tuple(r) for r in near_duplicate_pairs(frame(spark, rows), "i", ["title", "text"], threshold, run).collect()]
        assert len(got) == len(set(got))
        expected = brute(rows, threshold, run)
        assert set(got) <= expected
        assert len(expected - set(got)) <= len(expected) * 0.002


def test_normal_form_nulls_copies_and_repeats(spark):
    rows = [
        (1, "One two, THREE!", None), (2, "one two", "three"), (3, None, "one  two-three"), (4, None, None), (5, "", ""), (6, "one two", None), (7, "one two", ""),
        (None, "one two three", ""), (1, "One two, THREE!", None), (8, "Übung macht: one two three", "x"), (9, "x" * 100_000, "y z"), (10, "x" * 100_000, "Y-Z"),
    ]
    df = frame(spark, rows)
    got = {tuple(r) for r in near_duplicate_pairs(df, "i", ["title", "text"], 0.5, 3).collect()}
    assert got == brute([r for r in rows if r[0] is not None], 0.5, 3) and (1, 2) in got and (9, 10) in got and not any(6 in p for p in got)
    _, members = near_duplicates(df, "i", ["title", "text"], 0.5, 3)
    m = {r["i"]: r["class"] for r in members.collect()}
    assert len(m) == 10 and m[1] == m[2] == m[3] and m[6] == m[7]


def test_a_third_are_copies_of_one_text(spark):
    rng = random.Random(8)
    rows = corpus(rng, 200, 3)
    hot = " ".join(f"h{k}" for k in range(30))
    rows += [(1000 + i, "", hot) for i in range(100)] + [(2000, "", hot + " tail")]
    links, members = near_duplicates(frame(spark, rows), "i", ["title", "text"], 0.5, 3)
    classes = {r["i"]: r["class"] for r in members.collect()}
    assert len({classes[1000 + i] for i in range(100)}) == 1
    touching = [tuple(r)[:2] for r in links.collect() if classes[2000] in tuple(r)[:2]]
    assert touching == [tuple(sorted((classes[1000], classes[2000])))]


def test_empty(spark):
    assert near_duplicate_pairs(frame(spark, []), "i", ["title", "text"], 0.5, 3).collect() == []


def test_a_list_that_many_texts_share(spark, tmp_path):
    """Seven hundred different texts around one core: lists too long to be joined where they are met; from a file."""
    rng = random.Random(2)
    core = [f"core{k}" for k in range(40)]
    rows = [(i, "", " ".join(core + [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 16))])) for i in range(700)]
    rows += [(1000 + i, "", " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(50)] + [(2000, "", rows[0][2])]
    path = str(tmp_path / "in.parquet")
    frame(spark, rows).write.parquet(path)
    got = {tuple(r) for r in near_duplicate_pairs(spark.read.parquet(path), "i", ["title", "text"], 0.5, 3).collect()}
    expected = brute(rows, 0.5, 3)
    assert got <= expected and len(expected - got) <= 0.001 * len(expected)


def test_copies_beyond_one_part(spark, monkeypatch):
    from quillspan.llm import neardup

    monkeypatch.setattr(neardup, "SHARE_OF_CLASS", 7)
    rows = [(i, "one two three four", f"x{i % 2}") for i in range(40)]
    got = {tuple(r) for r in near_duplicate_pairs(frame(spark, rows), "i", ["title", "text"], 0.9, 3).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 == b % 2}
