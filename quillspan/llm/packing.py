"""Filling containers of fixed capacity, by bounded-space online packing."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut

#: Open windows a partition keeps per profile, and the items a task holds of one before it passes them on.
OPEN, HELD_ITEMS = 128, 4096
#: Partitions whose leftovers are merged in one group: OPEN times this many windows at most.
MERGED = 128

_ITEM = pa.struct([("item", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])
_WINDOW = pa.schema(
    [("profile", pa.string()), ("container", pa.string()), ("part", pa.int32()), ("is_open", pa.bool_()), ("begun", pa.bool_()), ("fill", pa.int64()), ("items", pa.list_(_ITEM))]
)
_WINDOW_SQL = "profile string, container string, part int, is_open boolean, begun boolean, fill bigint, items array<struct<item:bigint,piece:int,first_token:bigint,n_tokens:bigint>>"


class Packer:
    """The open windows of one profile in one partition."""

    def __init__(self, profile: str, capacity: int, part: int, most: int, held: int):
        self.profile, self.capacity, self.part, self.most, self.held = profile, capacity, part, most, held
        self.free: list[tuple[int, int]] = []  # (room, window), ascending: the fullest first
        self.items: dict[int, list[tuple]] = {}
        self.begun: set[int] = set()  # windows some of whose items were passed on
        self.made = 0
        self.out: list[tuple] = []

    def _pass_on(self, window: int, room: int, is_open: bool) -> None:
        row = (self.profile, f"{self.part}-{window}", self.part, is_open, window in self.begun, self.capacity - room, self.items.pop(window))
        self.out.append(row)

    def _place(self, item: tuple) -> None:
        size = item[3]
        k = bisect.bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, window = self.free.pop(k)
        else:
            if len(self.free) == self.most:
                full, old = self.free.pop(0)
                self._pass_on(old, full, False)
                self.begun.discard(old)
            room, window = self.capacity, self.made
            self.made += 1
            self.items[window] = []
        self.items[window].append(item)
        room -= size
        if not room:
            self._pass_on(window, room, False)
            self.begun.discard(window)
            return
        bisect.insort(self.free, (room, window))
        if len(self.items[window]) == self.held:  # the window stays open under its name
            self._pass_on(window, room, False)
            self.begun.add(window)
            self.items[window] = []

    def add(self, ident: int, size: int) -> None:
        at, piece = 0, 0
        while size - at > self.capacity:
            self._place((ident, piece, at, self.capacity))
            at, piece = at + self.capacity, piece + 1
        self._place((ident, piece, at, size - at))

    def take(self, last: bool) -> list[tuple]:
        if last:
            for room, window in self.free:
                self._pass_on(window, room, True)
            self.free = []
        rows, self.out = self.out, []
        return rows


def _fill(profiles: list[tuple[str, int]], most: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = [Packer(p, c, part, most, held) for p, c in profiles]
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for p in packers:
                for i, n in zip(ids, sizes, strict=True):
                    p.add(i, n)
            yield from _rows([r for p in packers for r in p.take(False)])
        yield from _rows([r for p in packers for r in p.take(True)])

    return run


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        *cells, items = zip(*rows, strict=True)
        fields = zip(*[x for row in items for x in row], strict=True) if any(items) else [[] for _ in _ITEM]
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(fields, _ITEM, strict=True)], fields=list(_ITEM))
        offsets = pa.array([0, *accumulate(map(len, items))], pa.int32())
        columns = [pa.array(c, f.type) for c, f in zip(cells, _WINDOW, strict=False)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat)], schema=_WINDOW)


def _merge(capacity_of: dict[str, int]):
    """Put left-over windows into each other: largest first, each where least room stays.

    A window some of whose items were passed on keeps its name and takes others in.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (not r["begun"], -r["fill"], r["part"], r["container"]))
        free: list[tuple[int, int]] = []
        out: list[dict] = []
        for r in rows:
            k = len(free) if r["begun"] else bisect.bisect_left(free, (r["fill"], -1))
            if k < len(free):
                room, at = free.pop(k)
                out[at]["items"] += r["items"]
                out[at]["fill"] += r["fill"]
            else:
                room, at = capacity_of[r["profile"]], len(out)
                out.append(r | {"is_open": False})
            bisect.insort(free, (room - r["fill"], at))
        return pa.Table.from_pylist(out, schema=_WINDOW)

    return run


def pack(df: DataFrame, ident: str, size: str, profiles: list[tuple[str, int]], open_windows: int = OPEN, held_items: int = HELD_ITEMS) -> DataFrame:
    """Where each item goes: (profile, container, item, piece, first_token, n_tokens), for every profile.

    Items larger than the capacity, and only those, are divided: pieces 0, 1, ... of one capacity each and the
    rest. An item of size 0 is placed like any other. Rows with a null ident or size are left out; a size
    below 0 is an error; repeated rows are items of their own; other columns are pruned; an empty table or no
    profiles give no rows. A container is named by its profile and its name, which is unique in the profile.

    Bounded-space online packing: each partition is read once as a stream, with at most open_windows windows
    open per profile. An item goes into the fullest window with room for it; if none has, the fullest window
    is closed and a new one opened. A window is closed when it is full, however many items that takes; the items
    held of it are passed on by the held_items. What is open at the end (at most open_windows a partition) is merged,
    largest first, in groups of 128 partitions. No item is ever sorted or shuffled for its size, and a task holds
    its open windows only.
    """
    if any(c < 1 for _, c in profiles):
        raise ValueError("a capacity must be 1 or more")
    if not profiles:
        profiles, df = [("none", 1)], df.limit(0)
    rows = df.select(F.col(ident).cast("long").alias("i"), F.col(size).cast("long").alias("n")).where("i IS NOT NULL AND n IS NOT NULL")
    rows = rows.withColumn("n", F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("an item has a size below 0"))))
    windows = cut(rows.mapInArrow(_fill(profiles, open_windows, held_items), _WINDOW_SQL))
    left = windows.where("is_open").withColumn("group", F.floor(F.col("part") / MERGED))
    merged = left.groupBy("profile", "group").applyInArrow(_merge_of(dict(profiles)), _WINDOW_SQL)
    every = windows.where("NOT is_open").unionByName(merged)
    return every.select("profile", "container", F.explode("items").alias("x")).select("profile", "container", F.col("x.item").alias(ident), "x.piece", "x.first_token", "x.n_tokens")


def _merge_of(capacity_of: dict[str, int]):
    step = _merge(capacity_of)

    def run(table: pa.Table) -> pa.Table:
        return step(table.drop_columns(["group"]))

    return run
