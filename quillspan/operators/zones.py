"""Versioned zone transition tables."""

from __future__ import annotations

import os
import zoneinfo
from datetime import UTC, datetime, timedelta
from functools import lru_cache

import numpy as np

#: Instants at which a zone may change are found between these years. Earlier ones have the first offset; in later
#: ones the rules repeat with the calendar, so their changes are those of the cycle of 400 years that begins here.
FIRST_YEAR, LAST_YEAR, CYCLE = 1800, 2100, 400
CYCLE_SECONDS = 146_097 * 86_400


@lru_cache(maxsize=1)
def tzdata_version() -> str:
    """The release of the zone rules the tables are built from, or 'unknown'."""
    for root in zoneinfo.TZPATH:
        for name, start in (("tzdata.zi", "# version "), ("+VERSION", "")):
            try:
                with open(os.path.join(root, name)) as f:
                    line = f.readline().strip()
            except OSError:
                continue
            if line.startswith(start):
                return line[len(start) :]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def require_version(version: str) -> None:
    """An error where the zone rules installed here are of another release than version."""
    if tzdata_version() != version:
        raise RuntimeError(f"zone rules differ: {version} at the driver, {tzdata_version()} here")


@lru_cache(maxsize=1024)
def resolve(name: str) -> str | None:
    """The zone of a name in any letter case, or None. A machine without zone rules is an error, not None."""
    try:
        zoneinfo.ZoneInfo(name)
        return name
    except (KeyError, ValueError, OSError):
        if not _by_lower():
            raise RuntimeError("no zone rules are installed here: add the tzdata package or the system's") from None
        return _by_lower().get(name.lower())


@lru_cache(maxsize=1)
def _by_lower() -> dict[str, str]:
    return {z.lower(): z for z in sorted(zoneinfo.available_timezones())}


class ZoneTable:
    """Offsets of one zone: at[i] is the UTC second from which offset[i+1] holds; offset[0] holds before. version is the rules' release."""

    def __init__(self, at: np.ndarray, offset: np.ndarray, abbreviations: dict[str, int], version: str, name: str, end: int):
        self.name, self.end = name, end
        self.at, self.offset, self.abbreviations, self.version = at, offset, abbreviations, version
        # Wall time moves on to a new offset when the later of both readings of the change has passed. So a
        # repeated hour keeps the offset before the change (the earlier instant), and so does a skipped one.
        self.wall = at + np.maximum(offset[:-1], offset[1:])

    def to_utc(self, wall_seconds: np.ndarray) -> np.ndarray:
        late = wall_seconds >= self.end
        if late.any():
            # 400 years are whole weeks, so a wall time of a later cycle has the offset of the same one in the first
            whole = (wall_seconds - self.end) // CYCLE_SECONDS * CYCLE_SECONDS
            cycle = zone_table(self.name, LAST_YEAR, LAST_YEAR + CYCLE)
            of = wall_seconds - np.where(late, whole, 0)
            then = cycle.offset[np.searchsorted(cycle.wall, of, side="right")]
            return wall_seconds - np.where(late, then, self.offset[np.searchsorted(self.wall, wall_seconds, side="right")])
        return wall_seconds - self.offset[np.searchsorted(self.wall, wall_seconds, side="right")]


@lru_cache(maxsize=1024)
def zone_table(name: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> ZoneTable:
    zone = zoneinfo.ZoneInfo(name)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)

    def look(second: int) -> tuple[int, str]:
        t = (epoch + timedelta(seconds=second)).astimezone(zone)
        return int(t.utcoffset().total_seconds()), t.tzname()

    begin = int((datetime(first, 1, 1, tzinfo=UTC) - epoch).total_seconds())
    end = int((datetime(last, 1, 1, tzinfo=UTC) - epoch).total_seconds())
    at, offsets = [], [look(begin)[0]]
    names: dict[str, int] = {look(begin)[1].lower(): offsets[0]}
    step = 6 * 86400
    a, was = begin, look(begin)
    while a < end:
        b = min(a + step, end)
        now = look(b)
        if now != was:
            lo, hi = a, b
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if look(mid) == was else (lo, mid)
            now = look(hi)
            if now[0] != was[0]:
                at.append(hi)
                offsets.append(now[0])
            names[now[1].lower()] = now[0]
            b = hi
        a, was = b, now
    words = {k: v for k, v in names.items() if k.isalpha() and k != "lmt"}
    return ZoneTable(np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64), words, tzdata_version(), name, end)
