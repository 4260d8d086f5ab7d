"""Long exact spans shared between records, by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.blobs import (
    BLOB_SCHEMA,
    Rolling,
    U,
    blob_batch,
    bucket_of,
    by_bucket,
    code_points,
    deltas,
    groups,
    mix,
    pack,
    text_batches,
    undelta,
    unpack,
)
from quillspan.llm.filters import only_keys_of
from quillspan.session import cut, input_mb, shuffle_parts

#: Perfect difference sets, period -> members. Any two residues are a member plus one same shift.
DIFFERENCE_SETS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
#: Megabytes of input a bucket, the most buckets, and the anchors a task holds before it sends them.
BUCKET_MB, MOST_BUCKETS, HELD_ANCHORS = 2, 200_000, 2_000_000
RUNS = "doc_id long, runs array<int>"
ARROW_RUNS = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.int32()))])


def _equal(h: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where each group of them begins; check holds further bits of each."""
    order = np.argsort(h, kind="stable")
    if check is not None and len(h):
        s, c = h[order], check[order]
        if ((s[1:] == s[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((check, h))
            s, c = h[order], check[order]
        return order, np.concatenate(([0], np.flatnonzero((s[1:] != s[:-1]) | (c[1:] != c[:-1])) + 1))
    return order, groups(h[order])


def _post(ids, doc, pos, h, bucket, buckets: int, bits: int, check=None) -> list[tuple[int, bytes]]:
    """The blobs of one batch of hashed windows.

    A hash that several records of this batch have is settled here: its windows are shared, and one entry
    without a place tells the other batches of it. So a window that a third of all records hold sends one
    entry a batch. All other entries carry record and place. check holds further bits of each hash.
    """
    order, first = _equal(h, check)
    d = ids[doc[order]]
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(first) else np.zeros(0, bool)
    settled = np.zeros(len(h), dtype=bool)
    settled[order] = np.repeat(many, np.diff(np.append(first, len(h))))
    rep = order[first[many]]
    out: list[tuple[int, bytes]] = []
    cut = (lambda x: (x & U(0xFFFFFFFF)).astype(np.uint32)) if bits == 32 else (lambda x: x)
    more = (lambda k: check[k]) if check is not None else (lambda k: np.zeros(0, np.uint32))
    none = np.zeros(0, dtype=np.int64)
    rep_parts = dict(by_bucket(bucket[rep], buckets)) if len(rep) else {}
    rest = np.flatnonzero(~settled)
    rest_parts = dict(by_bucket(bucket[rest], buckets)) if len(rest) else {}
    for b in rep_parts.keys() | rest_parts.keys():
        k = rest[rest_parts[b]] if b in rest_parts else none
        r = rep[rep_parts[b]] if b in rep_parts else none
        used, at = np.unique(doc[k], return_inverse=True)
        out.append((b, pack(np.array([0], np.uint8), cut(h[k]), more(k), cut(h[r]), more(r), deltas(ids[used]), deltas(at), deltas(pos[k]))))
    known = np.flatnonzero(settled)
    if len(known):
        used, at = np.unique(doc[known], return_inverse=True)
        out.append((int(ids[used[0]] % buckets), pack(np.array([1], np.uint8), deltas(ids[used]), deltas(at), deltas(pos[known]))))
    return out


def _runs(doc_ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """(record, place) pairs as one row a record, its places as runs: start, length, start, length ..."""
    order = np.lexsort((pos, doc_ids))
    d, p = doc_ids[order], pos[order]
    if not len(d):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int32()))], schema=ARROW_RUNS)
    keep = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])))
    d, p = d[keep], p[keep]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)))
    s = np.flatnonzero(new)
    length = np.diff(np.append(s, len(d)))
    flat = np.empty(2 * len(s), dtype=np.int32)
    flat[0::2], flat[1::2] = p[s], length
    rd = d[s]
    g = groups(rd)
    offsets = np.append(2 * g, len(flat)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(rd[g]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=ARROW_RUNS)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: the places whose hash another record has too."""
    hs, cs, ds, ps, is_rep, got_d, got_p = [], [], [], [], [], [], []
    for blob in (x for b in batches for x in b.column("blob")):
        kind, *a = unpack(blob.as_py())
        if kind[0]:
            ids, at, pos = map(undelta, a)
            got_d.append(ids[at])
            got_p.append(pos)
            continue
        h, c, r, rc, ids, at, pos = a[0], a[1], a[2], a[3], *map(undelta, a[4:])
        hs += [h, r]
        cs += [c, rc]
        ds += [ids[at] if len(at) else np.zeros(0, np.int64), np.zeros(len(r), np.int64)]
        ps += [pos, np.zeros(len(r), np.int64)]
        is_rep += [np.zeros(len(h), bool), np.ones(len(r), bool)]
    if sum(map(len, hs)):
        h, c, d, p, rep = map(np.concatenate, (hs, cs, ds, ps, is_rep))
        order, first = _equal(h, c if len(c) else None)
        sd, told = d[order], rep[order]
        size = np.diff(np.append(first, len(h)))
        # shared: records differ, or an entry tells that some batch has it more than once
        big = np.iinfo(np.int64)
        least, most = np.where(told, big.max, sd), np.where(told, big.min, sd)
        shared = np.logical_or.reduceat(told, first) | (np.minimum.reduceat(least, first) != np.maximum.reduceat(most, first))
        yes = order[np.repeat(shared, size) & ~told]
        got_d.append(d[yes])
        got_p.append(p[yes])
    d = np.concatenate(got_d) if got_d else np.zeros(0, np.int64)
    p = np.concatenate(got_p) if got_p else np.zeros(0, np.int64)
    yield _runs(d, p)


def _anchors(period: int, width: int, buckets: int):
    """Hash the windows of width at the cover places of every record."""
    covered = np.zeros(period, dtype=bool)
    covered[list(DIFFERENCE_SETS[period])] = True

    def send(held: list[tuple]) -> pa.RecordBatch:
        base = np.cumsum([0] + [len(x[0]) for x in held])
        ids, pos, h = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3))
        doc = np.concatenate([x[1] + b for x, b in zip(held, base, strict=False)])
        return blob_batch(_post(ids, doc, pos, h, bucket_of(h, buckets), buckets, 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for ids, texts in text_batches(batches):
            points, lens = code_points(texts)
            starts = np.cumsum(lens) - lens
            doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
            rel = np.arange(len(points), dtype=np.int64) - starts[doc]
            at = np.flatnonzero(covered[rel % period] & (rel + width <= lens[doc]))
            if len(at):
                held.append((ids, doc[at].astype(np.int64), rel[at], Rolling(points).at(at, width)))
            if sum(len(x[3]) for x in held) >= HELD_ANCHORS:
                yield send(held)
                held = []
        if held:
            yield send(held)

    return run


def _texts(buckets: int):
    """The texts, packed by bucket of their record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            rows = []
            for b, k in by_bucket(ids % buckets, buckets):
                raw = [texts[i].encode("utf-8", "surrogatepass") for i in k]
                body = np.frombuffer(b"".join(raw), dtype=np.uint8)
                rows.append((b, pack(ids[k], np.array([len(r) for r in raw], dtype=np.int64), body)))
            yield blob_batch(rows)

    return run


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i+width] at every i where that fits."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _extend(length: int, width: int, buckets: int):
    """Around every anchor met in another record, hash each window of full length that contains it."""
    gram = min(16, length)

    def run(cand: pa.Table, texts: pa.Table) -> pa.Table:
        runs: dict[int, list[np.ndarray]] = {}
        for i, r in zip(cand.column("doc_id").to_pylist(), cand.column("runs"), strict=True):
            runs.setdefault(i, []).append(np.asarray(r.values.to_numpy(), dtype=np.int64))
        rows: list[tuple[int, bytes]] = []
        if not runs:
            return pa.Table.from_batches([blob_batch(rows)])
        wanted = np.array(sorted(runs), dtype=np.int64)
        for blob in texts.column("blob"):
            ids, sizes, body = unpack(blob.as_py())
            body = body.tobytes()
            ends = np.cumsum(sizes)
            k = np.flatnonzero(np.isin(ids, wanted))
            if not len(k):
                continue
            own = [body[ends[i] - sizes[i] : ends[i]].decode("utf-8", "surrogatepass") for i in k]
            points, lens = code_points(own)
            starts = np.cumsum(lens) - lens
            change = np.zeros(len(points) + 1, dtype=np.int32)
            for j, i in enumerate(k):
                for r in runs[int(ids[i])]:
                    # a run of anchors p .. p+n-1 lies in the windows that start at p-(length-width) .. p+n-1
                    last = lens[j] - length
                    lo = np.clip(r[0::2] - (length - width), 0, None)
                    hi = np.minimum(r[0::2] + r[1::2], last + 1)
                    ok = lo < hi
                    np.add.at(change, starts[j] + lo[ok], 1)
                    np.add.at(change, starts[j] + hi[ok], -1)
            at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            if not len(at):
                continue
            doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[at]
            roll = Rolling(points)
            h = roll.at(at, length)
            # Neighbouring windows share their least gram, so their places stay together as runs.
            grams = roll.at(np.arange(len(points) - gram + 1), gram)
            least = mix(_window_min(grams, length - gram + 1)[at])
            rows += _post(ids[k], doc, at - starts[doc], h, bucket_of(least, buckets), buckets, 64, (least & U(0xFFFFFFFF)).astype(np.uint32))
        return pa.Table.from_batches([blob_batch(rows)])

    return run


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        d, s, e = [], [], []
        for i, r in zip(table.column("doc_id").to_pylist(), table.column("runs"), strict=True):
            a = np.asarray(r.values.to_numpy(), dtype=np.int64)
            d.append(np.full(len(a) // 2, i, dtype=np.int64))
            s.append(a[0::2])
            e.append(a[0::2] + a[1::2] - 1 + length)
        d, s, e = map(np.concatenate, (d, s, e))
        order = np.lexsort((s, d))
        d, s, e = d[order], s[order], e[order]
        # the furthest end so far within a record: ends are offset by the record's rank so one running maximum does
        rank = np.cumsum(np.concatenate(([0], d[1:] != d[:-1])))
        big = int(e.max()) + 1
        far = np.maximum.accumulate(e + rank * big) - rank * big
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > far[:-1])))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1
        return pa.table({"doc_id": d[first], "span_start": s[first], "span_end": far[last]})

    return run


def shared_spans(df: DataFrame, ident: str, text: str, length: int = 200) -> DataFrame:
    """The maximal stretches of each text whose characters lie in a run of length characters another record has too.

    ident is a whole number that names a record; several rows of one ident are one record and don't count as
    another (they should carry the same text; where they don't, their stretches are mixed). Returns
    (doc_id, span_start, span_end): code points counted from 0, end exclusive, touching stretches joined. A
    null text or ident, and a text shorter than length, give no row; other columns are pruned. length is 6
    at least.

    Difference-cover anchors: with a cover D of the residues modulo v, windows of length - v + 1 are hashed
    only where place mod v is in D. Two equal runs of full length, wherever they stand in their texts, have
    an anchor at the same offset, so both records meet in that anchor's bucket. Around anchors met, all
    windows of full length that contain the anchor are hashed and meet again, which extends each match to
    its exact ends; the work is linear in the shared text, and no pairs are formed. A window held by many
    records is settled within each batch first and sends one entry on (see _post). Only texts with an anchor met are
    moved. Windows of full length are compared by a 64-bit hash and, apart from that, by the hash of their least
    gram: its high half chooses the bucket and its low half must agree.
    """
    period = max(v for v in DIFFERENCE_SETS if v <= (length + 1) // 2)
    width = length - period + 1
    rows = df.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).where(f"doc_id IS NOT NULL AND char_length(text) >= {length}")
    spark = df.sparkSession
    buckets = max(shuffle_parts(spark), min(int(input_mb(df) / BUCKET_MB), MOST_BUCKETS))

    def by_bucket_of(blobs: DataFrame):
        return blobs.repartitionById(buckets, F.col("bucket")).groupBy("bucket")

    met = cut(by_bucket_of(rows.mapInArrow(_anchors(period, width, buckets), BLOB_SCHEMA)).applyInArrow(_meet, RUNS))
    packed = only_keys_of(met, "doc_id", rows, "doc_id").mapInArrow(_texts(buckets), BLOB_SCHEMA)
    here = met.withColumn("bucket", F.pmod("doc_id", F.lit(buckets)).cast("int"))
    windows = by_bucket_of(here).cogroup(by_bucket_of(packed)).applyInArrow(_extend(length, width, buckets), BLOB_SCHEMA)
    found = by_bucket_of(windows).applyInArrow(_meet, RUNS)
    last = found.withColumn("bucket", F.pmod("doc_id", F.lit(buckets)).cast("int"))
    return by_bucket_of(last).applyInArrow(_merge(length), "doc_id long, span_start long, span_end long")
