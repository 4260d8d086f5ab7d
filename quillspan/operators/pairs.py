"""All pairs within a group that tell of one event: records meet in blocks of a group, and pairs never leave their task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators.events import OF_SMALLER, OF_UNION, SAME_SOURCE, Variant

#: So many frequent words, two bytes each, are ordered by their frequency, all others come before them; any order is exact.
RANKED = 16384
#: Bits of the filter of words and addresses that more than one record has; what is moved for no reason grows with its load, the result stays.
CELLS = 1 << 23
BITMAP = 1 << 15
#: Records of a group from which it is divided further, and groups that may be.
DIVIDED, DIVIDED_GROUPS = 50_000, 1000
MOST_PARTS = 128
WORDS, ADDRESS, KEY = 0, 1, 2
#: Members of a block of common words from which one more word divides it; pairs looked at in one step.
CROWDED, STEP = 32, 1 << 21
SIGNATURE = 192
#: Sizes up to which two titles of one source can be one event by that rule alone.
SHORT = max(s for s in range(2, 100) if max(SAME_SOURCE[0], math.ceil(SAME_SOURCE[1] * s)) < OF_SMALLER[0])


def _by_words(both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((both >= OF_SMALLER[0]) & (both >= OF_SMALLER[1] * np.minimum(x, y))) | ((both >= OF_UNION[0]) & (both >= OF_UNION[1] * (x + y - both)))


def _least(size: np.ndarray) -> np.ndarray:
    """The common words that a title of this size has at least with any that is one event by words alone."""
    return np.where(OF_UNION[1] * size <= OF_UNION[0], OF_UNION[0], np.minimum(OF_SMALLER[0], np.ceil(OF_UNION[1] * size))).astype(np.int64)


def _part(code: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of its group that looks after a word."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 3: (0 0 1 1 1) and (0 1 0 1 2)."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def _steps(counts: np.ndarray) -> Iterator[slice]:
    """Slices that hold STEP in all, or one count of more."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        yield slice(at, to)
        at = to


def _equal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of equal values."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    for s in _steps(hi - lo):
        whose, k = _runs((hi - lo)[s])
        yield whose + s.start, order[lo[s][whose] + k]


def _encoded(group: Sequence[str], ident: str, ranked: np.ndarray, shared: np.ndarray):
    """Records with what they can have in common with others: an address, frequent words as ranks and others as hashes, both as bytes.

    ranked has hashes of frequent words, rarest first, shared the filter's bytes. A title's words become codes that sort
    as the order has them; those that no other record has come first of all and are only counted.
    """
    by_hash = np.argsort(ranked)
    hashes = ranked[by_hash]

    def met(h: np.ndarray) -> np.ndarray:
        cell = h & np.int64(CELLS - 1)
        return (shared[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, url = b.column("_w"), b.column("_u").to_numpy()
            size = np.diff(np.asarray(words.offsets)).astype(np.int64)
            flat, rec = words.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            code = -1 - (flat & np.int64(2**63 - 1))
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                code = np.where(hashes[at] == flat, by_hash[at], code)
            kept = (code >= 0) | met(flat)
            code, rec = code[kept], rec[kept]
            order = np.lexsort((code, rec))
            code, rec = code[order], rec[order]
            packed = []
            for own, kind in ((code < 0, np.int64), (code >= 0, np.uint16)):
                ends = np.concatenate([[0], np.cumsum(np.bincount(rec[own], minlength=len(size)))]) * kind().itemsize
                packed.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(code[own].astype(kind))]))
            cols = [b.column(c) for c in (*group, ident, "_s", "_k")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.where(met(url), url, 0)), pa.array(size.astype(np.int32)), *packed], [*group, ident, "_s", "_k", "_u", "_size", "_rare", "_w"])

    return run


def _codes(rare: pa.BinaryArray, ranked: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all titles, and how many each has."""
    parts = []
    for column, kind in ((rare, np.int64), (ranked, np.uint16)):
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
        flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if ends[-1] > ends[0] else np.empty(0, kind)
        parts.append((np.diff(ends).astype(np.int64) // kind().itemsize, flat))
    (few, first), (many, then) = parts
    count = few + many
    start = np.cumsum(count) - count
    code = np.empty(int(count.sum()), np.int64)
    each, k = _runs(few)
    code[start[each] + k] = first
    each, k = _runs(many)
    code[start[each] + few[each] + k] = then
    return code, count


def _deal(group: Sequence[str], ident: str, variant: Variant):
    """Each record to the parts of its group that look after its rarest words, its address and its event key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code, count = _codes(b.column("_rare"), b.column("_w"))
            parts, url, key, some, size = (b.column(c).to_numpy().astype(np.int64) for c in ("_n", "_u", "_k", "_any", "_size"))
            rec, start, least = np.repeat(np.arange(len(size)), count), np.cumsum(count) - count, _least(size)
            place = np.arange(len(code)) - start[rec] + (size - count)[rec]
            part = _part(code, parts[rec])
            home = some % parts
            of_source = (count >= SAME_SOURCE[0]) & variant.same_source
            short = of_source & (size <= SHORT)
            told = (count >= least) & ~short
            home[told] = part[start[told]]
            rare = (place < (size - least + 1)[rec]) & told[rec]
            lone = np.flatnonzero(of_source & ~short & ~told)
            met = np.unique(np.concatenate([rec[rare] * MOST_PARTS + part[rare], lone * MOST_PARTS + home[lone]]))
            who, of = _runs(np.where(short, parts, 0))
            keyed, each = _runs(np.where(key != 0, parts, 0))
            at_url = np.flatnonzero(url)
            whose = np.concatenate([met // MOST_PARTS, who, at_url, keyed])
            where = np.concatenate([met % MOST_PARTS, of, (url[at_url] & 0x7FFFFFFF) % parts[at_url], each])
            kind = np.repeat([WORDS, ADDRESS, KEY], [len(met) + len(who), len(at_url), len(keyed)])
            is_home = np.where(kind == KEY, (some % parts)[whose], home[whose]) == where
            for s in range(0, len(whose), 1 << 16):
                t = slice(s, s + (1 << 16))
                taken = pa.array(whose[t])
                cols = [b.column(c).take(taken) for c in (*group, ident, "_u", "_s", "_k", "_n", "_size")]
                cols += [b.column(c).take(pa.array(whose[t], mask=kind[t] != WORDS)).fill_null(b"") for c in ("_rare", "_w")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array((kind * MOST_PARTS + where)[t].astype(np.int32)), pa.array(is_home[t])], [*group, ident, "_u", "_s", "_k", "_n", "_size", "_rare", "_w", "_block", "_home"])

    return run


class _Titles:
    """The titles of one part of a group; a word that only one of them has is left out, but counted in its size.

    count is how many of a title's words are in code; the others came before them.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, size: np.ndarray):
        rec = np.repeat(np.arange(len(size)), count)
        place = np.arange(len(code)) - (np.cumsum(count) - count)[rec] + (size - count)[rec]
        _, word, often = np.unique(code, return_inverse=True, return_counts=True)
        kept = often[word] > 1
        self.size, self.rec, self.place, self.word, self.code, self.words = size, rec[kept], place[kept], word[kept], code[kept], max(len(often), 1)
        self.count = np.bincount(self.rec, minlength=len(size))
        self.counted: dict[int, np.ndarray] = {}
        self.start = np.cumsum(self.count) - self.count
        self.bits = np.zeros((3, len(size)), np.uint64)
        bit = self.word % SIGNATURE
        for i in range(3):
            own = bit // 64 == i
            np.bitwise_or.at(self.bits[i], self.rec[own], np.uint64(1) << (bit[own] % 64).astype(np.uint64))
        self.hidden = self.count - sum(np.bitwise_count(x).astype(np.int64) for x in self.bits)

    def at_most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A bound of the common words."""
        return sum(np.bitwise_count(x[a] & x[b]).astype(np.int64) for x in self.bits) + np.minimum(self.hidden[a], self.hidden[b])

    def common(self, a: np.ndarray, b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The common words of titles a and b, and those among them up to entry last of a."""
        n, first = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        order = np.argsort(self.count[a] * self.count[b], kind="stable")
        for s in _steps((self.count[a] * self.count[b])[order] // 4 + 1):
            o = order[s]
            x, y = a[o], b[o]
            wide = np.arange(int(self.count[y].max()))[:, None]
            other = np.where(wide < self.count[y], self.word[np.minimum(self.start[y] + wide, len(self.word) - 1)], -1).astype(np.int32)
            for i in range(int(self.count[x].max())):
                at = self.start[x] + i
                hit = (i < self.count[x]) & (other == self.word[np.minimum(at, len(self.word) - 1)].astype(np.int32)).any(0)
                n[o] += hit
                first[o] += hit & (at <= last[o])
        return n, first

    def blocks(self, ok: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(entry, entry, words) of two titles that share so many words, the first of which is ok.

        Of titles that are one event, the first common words are among all but the last ones in each: crowded blocks
        are divided by a further word, up to the number any two of them share.
        """
        least = _least(self.size)
        level = 1
        last = np.flatnonzero(ok & (self.place < (self.size - least + 1)[self.rec]))
        block = self.word[last]
        while len(last):
            order = np.argsort(block, kind="stable")
            last, block = last[order], block[order]
            head = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            members = np.diff(head, append=len(block))
            each, _ = _runs(members)
            met = members[each]
            now = (met > 1) & ((met <= CROWDED) | (level == OF_UNION[0])) & (level > 1)
            at = np.flatnonzero(now)
            after = (head + members)[each[at]] - at - 1
            for s in _steps(after):
                whose, k = _runs(after[s])
                mine = at[s][whose]
                yield last[mine], last[mine + 1 + k], level
            if level == OF_UNION[0]:
                return
            level += 1
            more = np.flatnonzero((met > 1) & ~now)
            own = self.rec[last[more]]
            inside = self.start[own] + np.minimum(self.count[own], self._before(own, level))
            whose, k = _runs(np.maximum(inside - last[more] - 1, 0))
            here = more[whose]
            block, last = each[here] * self.words + self.word[last[here] + 1 + k], last[here] + 1 + k

    def _before(self, own: np.ndarray, level: int) -> np.ndarray:
        """The kept words of titles own among those that can be their first common ones up to this level."""
        if level not in self.counted:
            self.counted[level] = np.bincount(self.rec[self.place < (self.size - _least(self.size) + level)[self.rec]], minlength=len(self.size))
        return self.counted[level][own]


def _found(ids: np.ndarray, url: np.ndarray, src: np.ndarray, key: np.ndarray, home: np.ndarray, size: np.ndarray, titles: tuple[np.ndarray, np.ndarray], parts: int, kind: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of records, each by the first rule it holds by: address, event key, words, source."""
    told = lambda a, b: ((url[a] == url[b]) & (url[a] != 0)) | ((key[a] == key[b]) & (key[a] != 0))
    if kind == ADDRESS:
        for a, b in _equal(url, url):
            yield a[ids[a] < ids[b]], b[ids[a] < ids[b]]
        return
    if kind == KEY:
        mine = np.flatnonzero(home)
        for a, b in _equal(key[mine], key):
            a = mine[a]
            new = (ids[a] < ids[b]) & ~((url[a] == url[b]) & (url[a] != 0))
            yield a[new], b[new]
        return
    w = _Titles(*titles, size)
    if not len(w.word):
        return
    for x, y, level in w.blocks(_part(w.code, np.full(len(w.code), parts)) == part):
        a, b = w.rec[x], w.rec[y]
        some = np.flatnonzero(_by_words(w.at_most(a, b), size[a], size[b]) & ~told(a, b))
        a, b = a[some], b[some]
        n, first = w.common(a, b, x[some])
        new = _by_words(n, size[a], size[b]) & (first == level)
        yield a[new], b[new]
    short = (size >= SAME_SOURCE[0]) & (size <= SHORT) & np.isin(src, src[home])
    if not short.any():
        return
    _, of = np.unique(src, return_inverse=True)
    one = np.flatnonzero(short[w.rec] & (w.place < (size - SAME_SOURCE[0] + 1)[w.rec]))
    two = np.flatnonzero(home[w.rec] & np.isin(src, src[short])[w.rec])
    for x, y in _equal(of[w.rec[one]] * w.words + w.word[one], of[w.rec[two]] * w.words + w.word[two]):
        x, a, b = one[x], w.rec[one[x]], w.rec[two[y]]
        some = np.flatnonzero((a != b) & (~short[b] | (ids[b] < ids[a])) & ~told(a, b))
        a, b = a[some], b[some]
        n, first = w.common(a, b, x[some])
        new = (n >= SAME_SOURCE[0]) & (n >= SAME_SOURCE[1] * np.minimum(size[a], size[b])) & ~_by_words(n, size[a], size[b]) & (first == 1)
        yield a[new], b[new]


def _meet(group: Sequence[str], ident: str, variant: Variant):
    def run(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        names = rows.column(ident).combine_chunks()
        order = pa.compute.array_sort_indices(names).to_numpy()
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order))
        url, src, event = (rows.column(c).to_numpy() for c in ("_u", "_s", "_k"))
        kind, part = divmod(key[len(group)].as_py(), MOST_PARTS)
        titles = _codes(*(rows.column(c).combine_chunks() for c in ("_rare", "_w")))
        size = rows.column("_size").to_numpy().astype(np.int64)
        home = rows.column("_home").combine_chunks().to_numpy(zero_copy_only=False)
        if not variant.same_source:
            home = np.zeros(len(home), bool) if kind == WORDS else home
        for a, b in _found(ids, url, src, event, home, size, titles, rows.column("_n")[0].as_py(), kind, part):
            for s in range(0, len(a), 1 << 18):
                x, y = a[s:s + (1 << 18)], b[s:s + (1 << 18)]
                less = ids[x] < ids[y]
                sides = [names.take(pa.array(np.where(less, x, y))), names.take(pa.array(np.where(less, y, x)))]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(x)) for k in key[:len(group)]), *sides], [*group, "left", "right"])

    return run


def _common(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the RANKED most frequent words, rarest first, and the filter of words and addresses that more than one row has.

    Both come from one count, in one query.
    """
    each = df.select(F.inline(F.concat(F.transform("_w", lambda x: F.struct(x.alias("v"), F.lit(1).alias("word"))), F.when(F.col("_u") != 0, F.array(F.struct(F.col("_u").alias("v"), F.lit(0).alias("word")))).otherwise(F.array().cast("array<struct<v:bigint,word:int>>")))))
    many = each.groupBy("v").agg(F.count("*").alias("f"), F.sum("word").alias("words")).where("f > 1 AND words <= f")
    ranked = many.orderBy(F.col("words").desc(), "f", "v").limit(RANKED).where("words > 1").select(F.col("v"), F.col("words").alias("f"), F.lit(None).cast("binary").alias("bits"))
    cell = F.col("v").bitwiseAND(CELLS - 1)
    maps = many.groupBy(F.shiftright(cell, 15).alias("v")).agg(F.bitmap_construct_agg(F.pmod(cell, F.lit(BITMAP))).alias("bits")).select("v", F.lit(0).cast("bigint").alias("f"), "bits")
    shared, words = np.zeros(CELLS // 8, np.uint8), []
    for r in ranked.union(maps).collect():
        if r["bits"] is None:
            words.append((r["f"], r["v"]))
        else:
            shared[r["v"] * (BITMAP // 8):(r["v"] + 1) * (BITMAP // 8)] = np.frombuffer(r["bits"], np.uint8)
    return np.array([v for _, v in sorted(words)], np.int64), shared


def pairs_within(df: DataFrame, ident: str, group: Sequence[str], variant: Variant, once: bool) -> DataFrame:
    """(group, left, right), left < right; df comes from event_columns. Unless each ident is there once, its rows are alike.

    Rows are made small before they are moved: words and addresses of one row only are left out, frequent words are
    numbers of two bytes. Words, addresses, keys and sources are told apart by 64-bit hashes.
    """
    known = F.lit(True)
    for g in group:
        known = known & F.col(g).isNotNull()
    rows = df.where(known)
    url, key, none = F.xxhash64("_url"), F.xxhash64("_key"), F.lit(0).cast("bigint")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_rows"))
    sizes = sizes.where(F.col("_rows") > DIVIDED).orderBy(F.col("_rows").desc()).limit(DIVIDED_GROUPS) if group else sizes
    rows = rows.select(
        *group, ident, F.when(F.lit(variant.url is not None) & (F.col("_url") != ""), url).otherwise(none).alias("_u"), F.xxhash64("_src").alias("_s"),
        F.when(F.lit(variant.event_key) & F.col("_key").isNotNull(), key).otherwise(none).alias("_k"), F.transform("_tok", lambda x: F.xxhash64(x)).alias("_w"),
    )
    fields = [rows.schema[c] for c in (*group, ident, "_s", "_k", "_u")]
    packed = [T.StructField("_size", T.IntegerType()), T.StructField("_rare", T.BinaryType()), T.StructField("_w", T.BinaryType())]
    rows = rows.mapInArrow(_encoded(group, ident, *_common(rows)), T.StructType([*fields, *packed]))
    if not once:
        others = [c for c in rows.columns if c != ident]
        rows = rows.groupBy(ident).agg(F.first(F.struct(*others)).alias("_row")).select(ident, *[F.col(f"_row.{c}").alias(c) for c in others])
    rows = rows.join(F.broadcast(sizes), list(group), "left") if group else rows.crossJoin(F.broadcast(sizes))
    parts = F.least(2 * F.greatest(F.ceil(F.coalesce("_rows", F.lit(0)) / DIVIDED), F.lit(1)), F.lit(MOST_PARTS)).cast("int")
    rows = rows.select(*group, ident, "_u", "_s", "_k", parts.alias("_n"), "_size", "_rare", "_w", F.pmod(F.xxhash64(ident), F.lit(1 << 30)).alias("_any"))
    kept = [f for f in rows.schema.fields if f.name != "_any"]
    dealt = rows.mapInArrow(_deal(group, ident, variant), T.StructType([*kept, T.StructField("_block", T.IntegerType()), T.StructField("_home", T.BooleanType())]))
    out = T.StructType([*(df.schema[g] for g in group), *(T.StructField(c, df.schema[ident].dataType) for c in ("left", "right"))])
    return dealt.groupBy(*group, "_block").applyInArrow(_meet(group, ident, variant), out)
