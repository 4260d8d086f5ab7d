"""Columnar exchange: many small postings travel as one binary per source batch and bucket.

A posting of a few bytes as a Spark row costs a row header, a JVM object and a sort entry. The operators here
send millions of them, so a task packs its postings of one bucket into arrays and Spark shuffles those.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOB_SCHEMA = "bucket int, blob binary"
ARROW_BLOB = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
#: Code points worked on at once; bounds a task's memory, not the data.
BATCH_CHARS = 2_000_000

U = np.uint64
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Hashes of any window of a code point array in constant time, by prefix sums of c * B**i."""

    _pow = np.ones(1, dtype=U)
    _inv = np.ones(1, dtype=U)

    def __init__(self, points: np.ndarray):
        n = len(points)
        if len(Rolling._pow) < n + 1:
            size = max(n + 1, 1 << 16)
            for name, base in (("_pow", _B), ("_inv", pow(_B, -1, 2**64))):
                a = np.full(size, base, dtype=U)
                a[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(a))
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(mix(points.astype(U)) * Rolling._pow[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[start + width] - self.sums[start]) * Rolling._inv[start], 7)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, each byte-shuffled and compressed where that pays."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
        packed = len(raw) > 64 and len(small) < 0.95 * len(raw)
        body = small if packed else raw
        kind = a.dtype.str.encode().ljust(4)
        parts += [struct.pack("<4sBII", kind, packed, len(a), len(body)), body]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(blob[0]):
        kind, packed, n, size = struct.unpack_from("<4sBII", blob, at)
        at += struct.calcsize("<4sBII")
        dtype = np.dtype(kind.decode().strip())
        raw = blob[at : at + size]
        at += size
        if packed:
            raw = pa.decompress(raw, decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
        out.append(np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, n).T.copy().reshape(-1).view(dtype) if n else np.zeros(0, dtype))
    return out


def deltas(a: np.ndarray) -> np.ndarray:
    """An int64 array as its differences, which compress; 32 bits where they suffice."""
    d = np.diff(a, prepend=0)
    return d.astype(np.int32) if len(d) and np.abs(d).max() < 2**31 else d


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """0 .. buckets-1 from the high half of a hash; the low half stays independent of it."""
    return (((h >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The index arrays of each bucket present, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(bucket) else None
    if edges is not None:
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                yield b, order[edges[b] : edges[b + 1]]
        return
    sb = bucket[order]
    cuts = np.flatnonzero(np.diff(sb)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=ARROW_BLOB)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(ids, texts) of about limit code points, from batches with the columns id and text; nulls are left out.

    A text longer than limit comes alone, whole.
    """
    ids: list[int] = []
    texts: list[str] = []
    chars = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is None or t is None:
                continue
            if ids and chars + len(t) > limit:
                yield np.array(ids, dtype=np.int64), texts
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(t)
            chars += len(t)
    if ids:
        yield np.array(ids, dtype=np.int64), texts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the length of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.array([len(t) for t in texts], dtype=np.int64)


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """The first index of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1))
