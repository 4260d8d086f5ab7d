"""Near-duplicate records, by an inverted join over signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.blobs import BLOB_SCHEMA, Rolling, U, blob_batch, bucket_of, by_bucket, code_points, deltas, groups, mix, pack, text_batches, undelta, unpack
from quillspan.llm.filters import only_keys_of
from quillspan.session import cut, input_mb, scratch, shuffle_parts

#: Coordinates of a signature, and how many minima make one.
COORDINATES, PER_COORDINATE = 128, 4
#: The chance to be missed that a pair at the threshold may have: it sets how many collisions a pair must have.
MISS = 3e-4
#: One-bit values of other minima that travel with a posting, and the part of a similar pair's collisions that must pass by them.
NEAR_BITS, PASS = 16, 0.9
#: A list of more texts than this is not joined where it is met but dealt out in tiles of so many.
LONG = 512
#: Texts whose postings a task holds before it sends them, pairs it holds before it counts and passes them on.
HELD_TEXTS, HELD_PAIRS = 100_000, 1 << 20
#: Megabytes of input (by the optimizer's estimate for the columns read) a bucket, and the most buckets.
BUCKET_MB, MOST_BUCKETS = 1, 200_000
#: Bits of a sketch (a multiple of 64) and standard deviations of slack, for pairs of long lists.
BITS, SLACK = 192, 3.7
#: Copies of one text that meet all others in one task.
SHARE_OF_CLASS = 2048
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32())])
PAIRS_SQL = "a long, b long, n int"
MET = pa.schema([*PAIRS, ("sketch", pa.binary())])
MET_SQL = "a long, b long, n int, sketch binary"


def normal_words(*cols: str) -> Column:
    """Lower-case runs of a-z and 0-9 of the columns in turn, one blank between; null columns are empty."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def shingle_hashes(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words of normal texts, and the number of them in each text."""
    points, lens = code_points(texts)
    ends = np.cumsum(lens)
    starts = ends - lens
    roll = Rolling(points)
    space = np.flatnonzero(points == 32)
    begin = np.sort(np.concatenate((starts[lens > 0], space + 1)))
    stop = np.sort(np.concatenate((ends[lens > 0], space)))
    word = mix((roll.sums[stop] - roll.sums[begin]) * Rolling._inv[begin], 3)
    per = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    count = np.maximum(per - run + 1, 0)
    first = np.cumsum(per) - per
    at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(len(at), dtype=U)
    for k in range(run):
        h = mix(h * U(0x9E3779B97F4A7C15) + word[at + k], 5)
    return h, count


def signatures(h: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """The least value of each of rows (an even number) hash functions over each text's shingles; texts must have one shingle at least.

    A 64-bit product gives two functions, its halves.
    """
    first = np.cumsum(count) - count
    rng = np.random.default_rng(20240229)  # the same functions in every task
    salt, factor = rng.integers(0, 2**64, rows // 2, dtype=U), rng.integers(0, 2**64, rows // 2, dtype=U) | U(1)
    out = np.empty((rows, len(count)), dtype=np.uint32)
    for r in range(rows // 2):
        halves = ((h ^ salt[r]) * factor[r]).view(np.uint32).reshape(-1, 2)
        out[2 * r] = np.minimum.reduceat(np.ascontiguousarray(halves[:, 0]), first)
        out[2 * r + 1] = np.minimum.reduceat(np.ascontiguousarray(halves[:, 1]), first)
    return out


def coordinate_values(sig: np.ndarray) -> np.ndarray:
    """One 64-bit value per text and coordinate, of PER_COORDINATE rows of the signature each."""
    rows, n = sig.shape
    out = np.empty((n, rows // PER_COORDINATE), dtype=U)
    for c in range(rows // PER_COORDINATE):
        part = sig[c * PER_COORDINATE : (c + 1) * PER_COORDINATE].astype(U)
        v = np.full(n, c, dtype=U)
        for k in range(0, PER_COORDINATE, 2):  # two minima are one 64-bit number
            v = mix(v * U(0x9E3779B97F4A7C15) + (part[k] << U(32) | part[k + 1]), 13)
        out[:, c] = v
    return out


def near_bits(sig: np.ndarray) -> np.ndarray:
    """For every text and coordinate, one bit of each of the NEAR_BITS minima that follow those of the coordinate."""
    bit = (mix(sig.astype(U), 11) & U(1)).astype(np.uint16)
    out = np.zeros((sig.shape[1], len(sig) // PER_COORDINATE), dtype=np.uint16)
    for c in range(out.shape[1]):
        for k in range(NEAR_BITS):
            out[:, c] |= bit[((c + 1) * PER_COORDINATE + k) % len(sig)] << np.uint16(k)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first BITS minima of every text, as bytes."""
    bit = (mix(sig[:BITS].astype(U), 11) & U(1)).astype(np.uint8)
    return np.packbits(bit.T, axis=1)


def _most(n: int, p: float, chance: float) -> tuple[int, float]:
    """The greatest m so that of n trials m succeed or more with this chance at least, and that chance."""
    upper, m = 1.0, 0
    while m < n and upper - (at := math.comb(n, m) * p**m * (1 - p) ** (n - m)) >= chance:
        upper, m = upper - at, m + 1
    return m, upper


def collisions_needed(threshold: float) -> tuple[int, int]:
    """How many bits of a posting must agree for a collision, and how many collisions a pair must have."""
    bits, passed = _most(NEAR_BITS, (1 + threshold) / 2, PASS)
    return bits, max(1, _most(COORDINATES, threshold**PER_COORDINATE * passed, 1 - MISS)[0])


def _post(run: int, buckets: int):
    """Post every text under each of its coordinates, packed by bucket."""

    def send(ids: np.ndarray, value: np.ndarray, near: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        _, one = np.unique(ids, return_index=True)
        ids, value, near, sketch = ids[one], value[one].reshape(-1), near[one].reshape(-1), sketch[one]
        doc = np.repeat(np.arange(len(ids)), COORDINATES)
        rows = []
        for b, k in by_bucket(bucket_of(value, buckets), buckets):
            used, at = np.unique(doc[k], return_inverse=True)
            rows.append((b, pack(deltas(ids[used]), deltas(at), (value[k] & U(0xFFFFFFFF)).astype(np.uint32), near[k])))
        for b, k in by_bucket(bucket_of(mix(ids.astype(U), 31), buckets), buckets):
            rows.append((b, pack(ids[k], sketch[k].reshape(-1))))
        return blob_batch(rows)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, texts in text_batches(batches):
            h, count = shingle_hashes(texts, run)
            some = np.flatnonzero(count)
            if len(some):
                sig = signatures(h, count[some], COORDINATES * PER_COORDINATE)
                held.append((ids[some], coordinate_values(sig), near_bits(sig), sketches(sig)))
            if sum(len(x[0]) for x in held) >= HELD_TEXTS:
                yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if held:
            yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return step


def _counted(ids: np.ndarray, pairs: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(pairs), return_counts=True)
    return _met(ids[pair >> 32], ids[pair & 0xFFFFFFFF], n)


def _met(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketch: list[bytes] | None = None) -> pa.RecordBatch:
    last = pa.nulls(len(a), pa.binary()) if sketch is None else pa.array(sketch, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), last], schema=MET)


def _meet(fewest_bits: int):
    """One bucket: pairs of texts that meet, with the number of their collisions here, and the members of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A member of a long list is the row (text, name of the list, 0), a sketch (text, 0, -1). Pairs are counted and passed on in batches."""
        ids, docs, values, bits, base = [], [], [], [], 0
        for blob in (x for b in batches for x in b.column("blob")):
            i, *rest = unpack(blob.as_py())
            if len(rest) == 1:
                none = np.zeros(len(i), np.int64)
                yield _met(i, none, none - 1, [x.tobytes() for x in rest[0].reshape(len(i), -1)])
                continue
            at, v, near = rest
            i = undelta(i)
            ids.append(i)
            docs.append(undelta(at) + base)
            values.append(v)
            bits.append(near)
            base += len(i)
        if not ids:
            return
        ids, rank = np.unique(np.concatenate(ids), return_inverse=True)
        key = (np.concatenate(values).astype(U) << U(32)) | rank[np.concatenate(docs)].astype(U)
        del docs, values
        order = np.argsort(key, kind="stable")
        key = key[order]
        one = groups(key)  # copies of a text post the same coordinates; one of each stays
        key, near = key[one], np.concatenate(bits)[order[one]]
        del order, bits
        value, doc = key >> U(32), (key & U(0xFFFFFFFF)).astype(np.int64)
        head = groups(value)
        size = np.diff(np.append(head, len(value)))
        long = np.repeat(size > LONG, size)
        if long.any():
            name = (value[long].astype(np.int64) << 31) ^ int(ids[0])  # with the bucket's least text, so other buckets' lists differ
            yield _met(ids[doc[long]], name, np.zeros(len(name)))
        found: list[np.ndarray] = []
        n, step = 0, 1
        at = np.flatnonzero(np.repeat((size > 1) & (size <= LONG), size))
        while len(at):
            at = at[at + step < len(key)]
            at = at[value[at] == value[at + step]]
            i = at[np.bitwise_count(near[at] ^ near[at + step]) <= NEAR_BITS - fewest_bits]
            for lo in range(0, len(i), HELD_PAIRS):
                k = i[lo : lo + HELD_PAIRS]
                found.append((doc[k] << 32) | doc[k + step])
                n += len(k)
                if n >= HELD_PAIRS:
                    yield _counted(ids, found)
                    found, n = [], 0
            step += 1
        if found:
            yield _counted(ids, found)

    return run


def _tiles(fewest: int):
    """Pairs of two tiles of a long list, or within one, whose sketches agree in fewest bits or more."""

    def read(b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return b.column("class").to_numpy(), np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1).view(U)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # two tiles of some LONG texts
        i, j = key[1].as_py(), key[2].as_py()
        of = table.column("tile").to_numpy()
        a, x = read(table.filter(pa.array(of == i)))
        b, y = read(table.filter(pa.array(of == j)))
        for k in range(len(a)):
            differ = np.bitwise_count(y ^ x[k]).sum(axis=1, dtype=np.int64)
            near = b[(differ <= BITS - fewest) & ((b > a[k]) if i == j else (b != a[k]))]
            if len(near):
                one = np.full(len(near), a[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, near)), pa.array(np.maximum(one, near)), pa.array(np.zeros(len(near), np.int32))], schema=PAIRS)

    return run


def _fewest_bits(threshold: float) -> int:
    """How many bits of two sketches agree at the threshold, less the slack."""
    agree = BITS * (1 + threshold) / 2
    return int(agree - SLACK * (agree * (1 - threshold) / 2) ** 0.5)


def _of_long_lists(long: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts that share a long list, dealt out over tasks by pairs of tiles; no pair is left out but by its sketch."""
    tiles = long.groupBy("list").agg(F.ceil(F.count("*") / LONG).cast("int").alias("tiles"))
    placed = long.join(tiles, "list").withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int")).join(sketch, "class")
    other = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = other.select("list", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), "tile", "class", "sketch")
    return cells.groupBy("list", "i", "j").applyInArrow(_tiles(_fewest_bits(threshold)), PAIRS_SQL).select("a", "b")


def _agreeing(fewest: int):
    """The pairs whose sketches agree in fewest bits or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= BITS - fewest
                yield b.filter(pa.array(near)).select(["a", "b"])

    return run


def _verify(run: int, threshold: float):
    """Exact Jaccard similarity of the two texts' sets of word runs."""

    def shingles(text: str) -> set:
        w = text.split(" ")
        return set(zip(*(w[k:] for k in range(run)), strict=False))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sim = [], []
            last, own = None, set()
            for i, (x, y) in enumerate(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)):
                if x != last:
                    last, own = x, shingles(x)
                other = shingles(y)
                both = len(own & other)
                j = both / (len(own) + len(other) - both) if both else 0.0
                if both and j >= threshold:
                    keep.append(i)
                    sim.append(j)
            k = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(k), b.column("b").take(k), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return step


def near_duplicates(df: DataFrame, ident: str, cols: list[str], threshold: float = 0.8, run: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links, members): links between texts whose sets of runs of words are similar, and the class of each record.

    The text of a record is the normal form of cols (see normal_words). Records of equal normal text are one
    class, named by the text's 64-bit hash. members has one row (ident, class) per ident and class; links has
    (a, b, similarity) with classes a < b for every two classes whose Jaccard similarity, which is checked
    exactly, is threshold or more. Copies are not expanded into pairs. Null columns count as empty; texts of
    fewer words than run have no set of runs: they are members of a class but have no links. Rows with a null
    ident are left out; repeated rows count once; other columns are pruned; an empty table gives empty results.

    Signature-coordinate inverted join. A signature holds the minima of 512 hash functions; four in turn form a
    coordinate, and each text is posted under each of its 128 coordinate-value pairs. A posting carries one bit of
    each of 16 other minima; a meeting in which too few of them agree is skipped (at most a tenth of those of similar
    texts). Collisions are counted per pair, and pairs with as many as two texts at the threshold have but with a
    chance of 3e-4 (31 at 0.8, the least of 1 at 0.5) are retained. Of these, pairs that can't be similar by 192 one-bit
    collisions (3.7 standard deviations) are dropped before any text is moved, and similarity is computed from the
    texts. The chance that a pair has no collision is 5e-4 at 0.5 and 1e-5 at 0.55. Copies, even a third of all rows, post the same class and collapse in each batch and
    bucket. A list of more than 512 different texts, a coordinate that many share, is dealt out over tasks by pairs
    of tiles, where the sketches alone decide which pairs go on.
    """
    spark = df.sparkSession
    bits, fewest = collisions_needed(threshold)
    docs = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), normal_words(*cols).alias("words"))
    docs = docs.select("id", F.xxhash64("words").alias("class"), (F.size(F.split("words", " ")) >= run).alias("has_runs"), "words")
    path = scratch(spark, "members")
    docs.select("id", "class", "has_runs").write.parquet(path)
    members = spark.read.parquet(path)
    buckets = max(1, min(int(input_mb(df) / BUCKET_MB), MOST_BUCKETS))
    buckets = max(shuffle_parts(spark), buckets)
    posted = docs.where("has_runs").select("class", "words").mapInArrow(_post(run, buckets), BLOB_SCHEMA)
    met = cut(posted.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_meet(bits), MET_SQL))
    counted = met.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sketch = met.where("n < 0").groupBy(F.col("a").alias("class")).agg(F.first("sketch").alias("sketch"))
    first, second = (sketch.select(F.col("class").alias(c), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    pairs = counted.where(F.col("n") >= fewest).select("a", "b").join(first, "a").join(second, "b").mapInArrow(_agreeing(_fewest_bits(threshold)), "a long, b long")
    long = met.where("n = 0").select(F.col("a").alias("class"), F.col("b").alias("list"))
    if not long.isEmpty():
        pairs = pairs.union(_of_long_lists(long, sketch, threshold)).distinct()
    pairs = cut(pairs)
    # one record stands for a class: only its text is made again, and moved
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    heads = cut(members.join(ends, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id")).select("id"))
    own = df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])
    again = only_keys_of(heads, "id", own, "id").withColumn("words", normal_words(*[f"_{i}" for i in range(len(cols))]))
    texts = again.select(F.xxhash64("words").alias("class"), "words").groupBy("class").agg(F.min("words").alias("words"))
    first = pairs.join(texts.select(F.col("class").alias("a"), F.col("words").alias("ta")), "a")
    both = first.join(texts.select(F.col("class").alias("b"), F.col("words").alias("tb")), "b")
    links = both.select("a", "b", "ta", "tb").mapInArrow(_verify(run, threshold), "a long, b long, similarity double")
    return links, members.withColumnRenamed("id", ident).distinct()


def near_duplicate_pairs(df: DataFrame, ident: str, cols: list[str], threshold: float = 0.8, run: int = 5) -> DataFrame:
    """near_duplicates with every class expanded: (a, b), a < b, for every two idents that are similar.

    As large as the answer itself: k copies of one text are k (k - 1) / 2 pairs. Use near_duplicates where
    links between classes do.
    """
    links, members = near_duplicates(df, ident, cols, threshold, run)
    m = members.where("has_runs")
    x, y = (m.select(F.col(ident).alias(i), F.col("class").alias(c)) for i, c in (("x", "a"), ("y", "b")))
    between = links.select("a", "b").join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # a class of k copies is k (k - 1) / 2 pairs: its members meet in parts, so that no task has a whole crowd
    crowd = m.groupBy("class").agg(F.count("*").alias("k")).where("k > 1").select("class", F.ceil(F.col("k") / SHARE_OF_CLASS).cast("int").alias("parts"))
    z = m.join(crowd, "class").select(F.col(ident).alias("x"), "class", "parts")
    one = z.withColumn("part", F.pmod(F.xxhash64("x"), "parts").cast("int"))
    every = z.select(F.col("x").alias("y"), "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = one.join(every, ["class", "part"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return between.union(within).distinct()
