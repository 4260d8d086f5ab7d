"""Deduplicating new batches against all history, by immutable suffix-array segments."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.blobs import U, bucket_of, by_bucket, deltas, mix, pack, undelta, unpack
from quillspan.llm.suffixes import Index, Titles, ranges
from quillspan.session import cut, remove, scratch

WORDS, NUMBERS = re.compile("[a-z0-9]+"), re.compile("[0-9]+")
#: Parameters that don't tell pages apart, besides utm_*.
TRACKING = {"fbclid", "gclid", "mc_cid", "mc_eid", "ref"}
#: Two titles are alike from this share of their words on (as a fraction), published this near.
SHARE = (7, 10)
NEAR_US = 72 * 3600 * 1_000_000
SPAN_US = 2 * NEAR_US
#: The most frequent words of the first history that are placed last in a title; bounds what is broadcast.
COMMON = 4096
#: Records of one step within a batch, and queries a task takes for one shard.
STEP_ROWS, TASK_QUERIES = 1_000_000, 200_000
#: Earlier records of its batch that a record is compared with in one pass; more of them are looked up in a further one.
LIKES = 16
#: Segments of one level that are merged into one of the next.
FAN = 4
#: Records a task packs at once, and how many records of a span make one more shard, and one more salt of a shard.
HELD_ROWS, SHARD_ROWS, SALT_ROWS = 50_000, 20_000, 1_000_000

PAGES = "pages"
QUERY, OWN, BOTH = 0, 1, 2
POSTING = pa.schema([("part", pa.string()), ("sub", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])
POSTING_SQL = "part string, sub int, salt int, kind int, n long, blob binary"
SEGMENT_SQL = "sub int, salt int, blob binary, seg int, part string"
MATCH_SQL = "rec long, batch long, of long, likes array<long>"


@dataclass
class Layout:
    """How records are laid out: per time span its shards and the salts of each, and the shards of pages.

    Salts divide a shard by record, so that one into which most records of its span fall stays bounded.
    """

    spans: dict[int, tuple[int, int]]
    pages: int

    @staticmethod
    def of(span_rows: dict[int, int], rows: int) -> Layout:
        return Layout({s: (1 + n // SHARD_ROWS, 1 + n // SALT_ROWS) for s, n in span_rows.items()}, 1 + rows // SHARD_ROWS)


def page_key(url: str | None) -> str | None:
    """What tells pages apart in an address: host without case and www., path without final slash, own parameters sorted."""
    if url is None:
        return None
    s = url.strip().partition("#")[0]
    s = s.partition("://")[2] if "://" in s.partition("?")[0] else s.removeprefix("//")
    rest, _, query = s.partition("?")
    host, _, path = rest.partition("/")
    host = host.lower().removeprefix("www.")
    if not host and not path:
        return None
    params = sorted(p for p in query.split("&") if p and not (k := p.partition("=")[0].lower()).startswith("utm_") and k not in TRACKING)
    return f"{host}/{path.removesuffix('/')}?{'&'.join(params)}"


def ordered_words(title: str, rank: dict[str, int]) -> list[str]:
    """The set of words of a title in one global order, words that are rare in the history first."""
    return sorted(set(WORDS.findall(title.lower())), key=lambda w: (rank.get(w, -1), w))


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _hashes(texts: list[str]) -> np.ndarray:
    """The hash of each text; repeated texts are hashed once."""
    known: dict[str, int] = {}
    return np.array([known[t] if t in known else known.setdefault(t, hash64(t)) for t in texts], dtype=U)


def _span(at: np.ndarray) -> np.ndarray:
    return np.floor_divide(at, SPAN_US)


def _prefix(n: np.ndarray) -> np.ndarray:
    """Of n words in order, the first ones of which two sets that are alike share one at least."""
    return np.where(n > 0, n - (n * SHARE[0] + SHARE[1] - 1) // SHARE[1] + 1, 0)


def _post(rank: dict[str, int], layout: Layout, asking: bool):
    """The records' texts, packed for the shards in which their suffixes lie (see Layout).

    A title's text is its set of words, those rare in the history first. Its suffixes that begin in the first
    n - ceil(0.7 n) + 1 of n words are enough, since two sets with 70 % of their union in common, both in one
    order, share a word within these. A time span is twice as long as titles may lie apart, so a query asks two:
    that of the earliest and that of the latest time it may match, one of which is its own.
    """

    def titles(batch, rec, title, at) -> Iterator[tuple]:
        rows = [(b, r, ordered_words(t, rank), ",".join(sorted(set(NUMBERS.findall(t)))), a) for b, r, t, a in zip(batch, rec, title, at, strict=True) if t and a is not None]
        rows = [r for r in rows if r[2]]
        if not rows:
            return
        b, r, words, numbers, a = zip(*rows, strict=True)
        b, r, a = (np.array(x, dtype=np.int64) for x in (b, r, a))
        size = np.array([len(w) for w in words], dtype=np.int64)
        scope, word = _hashes(list(numbers)), _hashes([w for ws in words for w in ws])
        start, n = np.cumsum(size) - size, _prefix(size)
        of, seed = np.repeat(np.arange(len(r)), n), ranges(start, n)
        key = mix(word[seed] * U(3) + scope[of], 17)
        own = _span(a)
        for home in (True, False) if asking else (True,):
            span = own if home else np.where(_span(a - NEAR_US) != own, _span(a - NEAR_US), _span(a + NEAR_US))
            for s in np.unique(span).tolist():
                if s not in layout.spans:
                    continue  # no record lies there
                subs, salts = layout.spans[s]
                k = np.flatnonzero(span[of] == s)
                for sub, at_sub in by_bucket(bucket_of(key[k], subs), subs):
                    mine = k[at_sub]
                    used, seed_of = np.unique(of[mine], return_inverse=True)
                    held = np.cumsum(size[used]) - size[used]
                    part = Titles(b[used], r[used], a[used], scope[used], size[used], word[ranges(start[used], size[used])], seed[mine] - start[of[mine]] + held[seed_of], seed_of)
                    yield from dealt(str(s), sub, home, part.rec, salts, part)

    def pages(batch, rec, url) -> Iterator[tuple]:
        rows = [(p, b, r) for b, r, p in ((b, r, page_key(u)) for b, r, u in zip(batch, rec, url, strict=True)) if p]
        if rows:
            text = np.array(["\x02" + p for p, _, _ in rows], dtype=object)
            b, r = (np.array([x[k] for x in rows], dtype=np.int64) for k in (1, 2))
            for sub, k in by_bucket(bucket_of(_hashes(text.tolist()), layout.pages), layout.pages):
                z = np.zeros(len(k), dtype=np.int64)
                yield PAGES, sub, 0, BOTH, len(k), Segment(text[k].tolist(), b[k], r[k], z, z).blob()

    def dealt(part: str, sub: int, home: bool, rec: np.ndarray, salts: int, t: Titles) -> Iterator[tuple]:
        """Records are dealt out over the salts of a shard; queries go to each of them."""
        if salts == 1:
            yield part, sub, 0, BOTH if home else QUERY, len(rec), t.pack()
            return
        salt = (mix(rec.astype(U), 29) % U(salts)).astype(np.int64)
        packed = t.pack() if asking else b""
        for s in range(salts):
            if asking:
                yield part, sub, s, QUERY, len(rec), packed
            if home and (own := t.only(salt == s)) is not None:
                yield part, sub, s, OWN if asking else BOTH, len(own.rec), own.pack()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _held(batches):
            batch, rec, title, url, at = (t.column(k).to_pylist() for k in ("batch", "rec", "title", "url", "at"))
            out = [*titles(batch, rec, title, at), *pages(batch, rec, url)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), POSTING, strict=True)], schema=POSTING)

    return run


def _held(batches: Iterator[pa.RecordBatch], rows: int = HELD_ROWS) -> Iterator[pa.Table]:
    """Arrow batches put together up to a number of rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Segment:
    """A suffix array over the concatenated text of one shard: its suffixes in order, with record, size and time."""

    texts: list[str]
    batch: np.ndarray
    rec: np.ndarray
    n: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(texts: list[str], batch: np.ndarray, rec: np.ndarray, n: np.ndarray, at: np.ndarray) -> Segment:
        order = sorted(range(len(texts)), key=texts.__getitem__)
        return Segment([texts[i] for i in order], batch[order], rec[order], n[order], at[order])

    def blob(self) -> bytes:
        raw = [t.encode("utf-8", "surrogatepass") for t in self.texts]
        text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        return pack(text, np.array([len(r) for r in raw], dtype=np.int64), deltas(self.batch), deltas(self.rec), self.n, deltas(self.at))

    @staticmethod
    def read(blob: bytes) -> Segment:
        text, size, batch, rec, n, at = unpack(blob)
        body, ends = text.tobytes(), np.cumsum(size).tolist()
        texts = [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)]
        return Segment(texts, undelta(batch), undelta(rec), n, undelta(at))

    def find(self, start: str, stop: str) -> tuple[int, int]:
        """The interval of suffixes from start on and before stop."""
        lo = bisect_left(self.texts, start)
        if lo == len(self.texts) or self.texts[lo] >= stop:
            return lo, lo
        return lo, bisect_left(self.texts, stop, lo)


def _bounds(text: str) -> tuple[str, str]:
    """Between what suffixes lie that share the beginning: all of a page key, or up to the first word's end."""
    if text[0] == "\x02":
        return text, text + "\x00"
    start = text[: text.index(" ") + 1]
    return start, start[:-1] + "!"


def _merge(blobs: list[bytes], page: bool) -> bytes:
    """Records packed for one shard, or segments of it, as one segment."""
    if not page:
        return Titles.join([Titles.read(b) for b in blobs]).sorted().pack()
    parts = [Segment.read(b) for b in blobs]
    texts = [t for p in parts for t in p.texts]
    batch, rec, n, at = (np.concatenate([getattr(p, k) for p in parts]) for k in ("batch", "rec", "n", "at"))
    arrival = np.lexsort((rec, batch))  # equal texts keep this order
    return Segment.of([texts[i] for i in arrival], batch[arrival], rec[arrival], n[arrival], at[arrival]).blob()


def _build(table: pa.Table) -> pa.Table:
    part, sub, salt = (table.column(k)[0].as_py() for k in ("part", "sub", "salt"))
    blob = _merge([b.as_py() for b in table.column("blob")], part == PAGES)
    return pa.table({"sub": pa.array([sub], pa.int32()), "salt": pa.array([salt], pa.int32()), "blob": pa.array([blob], pa.binary()), "part": [part]})


def _same_pages(segments: list[Segment], own: Segment, asked: Segment) -> tuple[dict[int, tuple[int, int]], dict[int, list[int]]]:
    """For each query the earliest accepted record of its page, and the earliest ones before it in its own batch."""
    old: dict[int, tuple[int, int]] = {}
    new: dict[int, list[int]] = {}
    for text, rec in zip(asked.texts, asked.rec.tolist(), strict=True):
        start, stop = _bounds(text)
        for s in segments:
            lo, hi = s.find(start, stop)
            if lo < hi:
                best = min(zip(s.batch[lo:hi].tolist(), s.rec[lo:hi].tolist(), strict=True))
                old[rec] = min(old.get(rec, best), best)
        lo, hi = own.find(start, stop)
        if lo < hi:
            first = own.rec[lo : min(hi, lo + LIKES)]
            if len(first := first[first < rec]):
                new[rec] = first.tolist()
    return old, new


def _like_titles(segments: list[Titles], own: Titles, asked: Titles) -> tuple[dict[int, tuple[int, int]], dict[int, list[int]]]:
    """The same for titles."""
    old: dict[int, tuple[int, int]] = {}
    new: dict[int, list[int]] = {}
    for s in segments:
        i, j = Index(s).alike(asked, 1, NEAR_US, SHARE)
        for rec, *best in zip(asked.rec[i].tolist(), s.batch[j].tolist(), s.rec[j].tolist(), strict=True):
            old[rec] = min(old.get(rec, tuple(best)), tuple(best))
    i, j = Index(own).alike(asked, LIKES, NEAR_US, SHARE, np.searchsorted(own.rec, asked.rec))
    for rec, like in zip(asked.rec[i].tolist(), own.rec[j].tolist(), strict=True):
        new.setdefault(rec, []).append(like)
    return old, new


def _search(index: pa.Table, queries: pa.Table) -> pa.Table:
    """For each query of a shard the earliest accepted record it is like, and the earliest before it in its own batch."""
    old, new = {}, {}
    if queries.num_rows:
        page = queries.column("part")[0].as_py() == PAGES
        kind = queries.column("kind").to_numpy()
        of = lambda k: [b.as_py() for b, x in zip(queries.column("blob"), kind, strict=True) if x in (k, BOTH)]
        segments = [b.as_py() for b in index.column("blob")]
        if page:
            asked = [Segment.read(b) for b in of(QUERY)]
            one = Segment([t for p in asked for t in p.texts], *(np.concatenate([getattr(p, k) for p in asked]) for k in ("batch", "rec", "n", "at"))) if asked else None
            if one:
                old, new = _same_pages([Segment.read(b) for b in segments], Segment.read(_merge(of(OWN), True)), one)
        else:
            old, new = _like_titles([Titles.read(b) for b in segments], Titles.join([Titles.read(b) for b in of(OWN)]).sorted(), Titles.join([Titles.read(b) for b in of(QUERY)]))
    recs = sorted(old.keys() | new.keys())
    batch, of = ([old[r][k] if r in old else None for r in recs] for k in (0, 1))
    return pa.table([pa.array(recs, pa.int64()), pa.array(batch, pa.int64()), pa.array(of, pa.int64()), pa.array([new.get(r) for r in recs], pa.list_(pa.int64()))], names=["rec", "batch", "of", "likes"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one step in arrival order: which one each repeats, or that it stays open.

    A record like an accepted one repeats the earliest of these. Else the first of the records before it that it is
    like and that is accepted, so none of those that repeat another. It stays open if one of them is open, or if all
    that are known repeat another and there may be more.
    """
    repeats: set[int] = set()
    opened: set[int] = set()
    for b in batches:
        out: list[tuple] = []
        for rec, of, likes, more in zip(*(b.column(k).to_pylist() for k in ("rec", "of", "likes", "more")), strict=True):
            found = of
            is_open = False
            if of is None:
                found = next((x for x in likes if x not in repeats), None)
                is_open = found in opened or (found is None and more)
            if is_open:
                opened.add(rec)
                out.append((rec, None))
            elif found is not None:
                repeats.add(rec)
                out.append((rec, found))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["rec", "accepted"])


def _dealt(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of a crowded shard are dealt out over several tasks, each of which gets all that is searched there."""
    keys = ["part", "sub", "salt"]
    crowd = queries.where(F.col("kind") != OWN).groupBy(*keys).agg(F.ceil(F.sum("n") / TASK_QUERIES).cast("int").alias("tasks")).where("tasks > 1")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)).alias("deal")
    tasks = queries.join(crowd, keys, "left").withColumn("_own", F.pmod(F.xxhash64("blob"), F.coalesce("tasks", F.lit(1))).cast("int")).select("*", every)
    here = F.col("deal") == F.col("_own")
    # own records go to all tasks to be searched, queries ask in one of them
    kind = F.when(F.col("kind") == BOTH, F.when(here, BOTH).otherwise(OWN)).when((F.col("kind") == OWN) | here, F.col("kind"))
    asked = tasks.select("part", "sub", "salt", "deal", kind.alias("kind"), "n", "blob").where("kind IS NOT NULL")
    return index.join(crowd, keys, "left").select("part", "sub", "salt", every, "blob"), asked


class History:
    """All accepted records, as immutable segments in the shared folder.

    A segment is written in folders by time span, and a folder for pages; a batch opens the folders of the spans its
    own records ask for, and that of pages. Segments of one level have like sizes; FAN of a level are merged into one
    of the next, so there are as many as the logarithm of the batches, and a record is rewritten as often.
    """

    def __init__(self, spark: SparkSession, layout: Layout, rank: dict[str, int]):
        self.spark, self.layout, self.rank = spark, layout, rank
        self.root = scratch(spark, "segments")
        self.made = 0
        self.levels: list[tuple[int, str]] = []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SEGMENT_SQL).option("basePath", self.root).parquet(*paths).drop("seg")

    def _write(self, packed: DataFrame) -> str:
        self.made += 1
        path = f"{self.root}/seg={self.made}"
        # partitioned by (part, sub), which the grouping keeps, so that a folder has a file for some of its shards each
        packed.repartition("part", "sub").groupBy("part", "sub", "salt").applyInArrow(_build, "sub int, salt int, blob binary, part string").write.partitionBy("part").parquet(path)
        return path

    def accept(self, records: DataFrame, level: int = 0) -> None:
        """Add records (batch, rec, title, url, at) as accepted, without a check."""
        self.levels.append((level, self._write(records.mapInArrow(_post(self.rank, self.layout, False), POSTING_SQL))))
        while len(self.levels) >= FAN and self.levels[-1][0] >= self.levels[-FAN][0]:
            merged = self.levels[-FAN:]
            self.levels[-FAN:] = [(merged[0][0] + 1, self._write(self._read([path for _, path in merged])))]
            for _, path in merged:
                remove(self.spark, path)

    def folders(self, spans: list[int]) -> DataFrame:
        """What of the segments a batch that asks for these spans has to read."""
        return self._read([p for _, p in self.levels]).where(F.col("part").isin(PAGES, *map(str, spans)))

    def check(self, records: DataFrame, size: int, spans: list[int]) -> list[DataFrame]:
        """Take size records of one batch in arrival order: repeats come out as (accepted_rec, repeat_rec), the rest is accepted."""
        out: list[DataFrame] = []
        while size:
            index = self.folders(spans)
            queries = records.mapInArrow(_post(self.rank, self.layout, True), POSTING_SQL)
            keys = ["part", "sub", "salt"]
            if size > TASK_QUERIES:  # a smaller batch can't crowd a shard
                index, queries = _dealt(index, queries)
                keys.append("deal")
            found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search, MATCH_SQL)
            likes = F.array_sort(F.array_distinct(F.flatten(F.collect_list("likes"))))
            full = F.coalesce(F.max(F.size("likes")), F.lit(0)) >= LIKES
            old = F.when(F.col("of").isNotNull(), F.struct("batch", "of"))
            near = found.groupBy("rec").agg(F.min(old).alias("old"), likes.alias("likes"), full.alias("full")).select(
                "rec", F.col("old.of").alias("of"), F.slice("likes", 1, LIKES).alias("likes"), (F.col("full") | (F.size("likes") > LIKES)).alias("more")
            )
            # one pass over the step's records that are like others, STEP_ROWS at most
            told = cut(near.repartition(1).sortWithinPartitions("rec").mapInArrow(_decide, "rec long, accepted long"))
            self.accept(records.join(told.select("rec"), "rec", "left_anti").select(*records.columns))
            out.append(told.where("accepted IS NOT NULL").select(F.col("accepted").alias("accepted_rec"), F.col("rec").alias("repeat_rec")))
            left = told.where("accepted IS NULL").select("rec")
            size = left.count()
            if size:
                records = cut(records.join(left, "rec", "left_semi").select(*records.columns))
        return out

    def close(self) -> None:
        remove(self.spark, self.root)
        self.levels = []


def _records(df: DataFrame, batch: str, rec: str, title: str, url: str, at: str) -> DataFrame:
    us: Column = F.unix_micros(F.col(at).cast("timestamp"))
    return df.select(F.col(batch).cast("long").alias("batch"), F.col(rec).cast("long").alias("rec"), F.col(title).alias("title"), F.col(url).alias("url"), us.alias("at")).where("batch IS NOT NULL AND rec IS NOT NULL")


def common_words(records: DataFrame, most: int = COMMON) -> dict[str, int]:
    """The most frequent words of the titles, at most `most` of them, ranked from rare to frequent; counted over all rows."""
    words = records.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z0-9]+)")))).alias("w"))
    top = words.groupBy("w").count().where("count > 1").orderBy(F.col("count").desc(), "w").limit(most).collect()
    return {r["w"]: i for i, r in enumerate(reversed(top))}


def repeats_of_history(df: DataFrame, batch: str, rec: str, title: str, url: str, at: str) -> DataFrame:
    """(accepted_rec, repeat_rec) for batches after the first, taken in the order of (batch, rec).

    The first batch is accepted as it is. A record repeats an accepted one if their page keys are equal, or if
    both times are present and at most 72 hours apart, the numbers in the titles are the same set and 70 % of
    the union of their sets of words is common; it comes out with the earliest such record. All others are
    accepted. rec must be unique; rows that repeat a rec count as one. Rows with a null batch or rec are left
    out. A record whose title has no word, or is null, repeats by its page only; one with neither page nor
    time is always accepted. Other columns are pruned. An empty table, or one batch, gives no rows.

    Accepted records lie in immutable segments, one a batch, which merge logarithmically. A segment is cut into
    shards by time span and by the hash of a suffix's first word and its title's numbers; a shard holds its records'
    titles as one concatenated text of word numbers in one global order, rare words first, and a suffix array of it.
    A batch reads the folders of the spans it asks for. Each suffix of a title is binary-searched for its longest
    match, whose record bounds the search, then all suffixes that begin with its first word are passed in
    arrival order; the coverage of a matched record is counted over all its words and decides exactly. Suffixes that
    begin in the first n - ceil(0.7 n) + 1 words suffice (a prefix filter). Pages are sorted texts of their own, looked up whole;
    their folder (an address, a record and a batch number a record) is read once a batch.

    A shard of a span with very many records is dealt out by record over several tasks, and the queries of a crowded
    shard as well. What is left of a batch is compared within itself in the same way, and decided by one pass in
    arrival order over the records that are like others, in steps of STEP_ROWS records at most. A record that is like
    more than LIKES earlier ones of its batch, all repeats themselves, is looked up again.
    """
    spark = df.sparkSession
    path = scratch(spark, "records")
    _records(df, batch, rec, title, url, at).dropDuplicates(["rec"]).write.partitionBy("batch").parquet(path)
    records = spark.read.schema("rec long, title string, url string, at long, batch long").parquet(path).select("batch", "rec", "title", "url", "at")
    # one row per batch and time span, some sixty a year
    span = F.expr(f"(at - pmod(at, {SPAN_US})) div {SPAN_US}")
    counts = records.groupBy("batch", span.alias("span")).count().collect()
    empty = spark.createDataFrame([], "accepted_rec long, repeat_rec long")
    sizes: dict[int, int] = {}
    spans: dict[int, set[int]] = {}
    total: dict[int, int] = {}
    for r in counts:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + r["count"]
        if r["span"] is not None:
            spans.setdefault(r["batch"], set()).update(r["span"] + k for k in (-1, 0, 1))
            total[r["span"]] = total.get(r["span"], 0) + r["count"]
    if not sizes:
        return empty
    first, *later = sorted(sizes)
    start = records.where(F.col("batch") == first)
    history = History(spark, Layout.of(total, sum(sizes.values())), common_words(start))
    history.accept(start, level=1 + int(np.log(max(1, sizes[first] / max(1, sizes[later[0]] if later else 1))) / np.log(FAN)))
    out = [empty]
    for b in later:
        rows, n = records.where(F.col("batch") == b), sizes[b]
        steps = -(-n // STEP_ROWS)
        bounds = rows.approxQuantile("rec", [k / steps for k in range(1, steps)], 0.01) if steps > 1 else []
        for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
            part = rows if lo is None else rows.where(F.col("rec") > int(lo))
            out += history.check(part if hi is None else part.where(F.col("rec") <= int(hi)), -(-n // steps), sorted(spans.get(b, set()) & total.keys()))
    history.close()
    remove(spark, path)
    found = out[0]
    for o in out[1:]:
        found = found.union(o)
    return found
