"""Mixed timestamp formats and time zones, made one UTC instant."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.zones import require_version, resolve, tzdata_version, zone_table

# Month names and their common short forms in English, German, French and Spanish.
MONTHS = {
    1: "jan january januar jänner janvier janv enero ene",
    2: "feb february februar février fevrier févr fevr fév febrero",
    3: "mar march märz maerz mär mrz mars marzo",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre",
    10: "oct october oktober okt octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember dez décembre decembre déc diciembre dic",
}
# Weekday names, words between date and time, words after a time.
WEEKDAYS = set(
    "mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday mo di mi do fr sa so "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lun mer jeu ven sam dim lundi mardi mercredi jeudi vendredi samedi dimanche".split()
)
LINKS = {"", "t", "at", "à", "a", "um", "u", "on"}
AFTER = {"uhr", "h", "hrs"}
UTC_WORDS = {"z", "utc", "gmt", "ut", "zulu"}
MONTH_OF = {w: m for m, words in MONTHS.items() for w in words.split()}

#: Characters converted at once, and up to which length masks are kept; bound memory only.
CELLS, KEPT_MASK = 4_000_000, 256

# Shapes, in masks: 9 is a digit, a a letter, anything else itself. The first that fits the whole mask is taken.
_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<w1>a\.a\.|a+))?"
_ZONE = r"(?: ?(?P<sg>[+-])(?P<oh>99)(?::?(?P<om>99))?)?(?: (?P<w2>a+))?(?: ?\[(?P<zn>[a/_+9-]+)\])?"
_LINK = r"(?:,? (?P<cn>a+) |(?P<ct>a)|,? )"
_DATES = [
    r"(?P<Y>9999)-(?P<m>99?)-(?P<d>99?)",
    r"(?P<Y>9999)/(?P<m>99?)/(?P<d>99?)",
    r"(?P<p>99?)/(?P<q>99?)/(?P<Y>9999|99)",
    r"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999|99)",
    r"(?:(?P<wd>a+)\.?,? )?(?P<d>99?)(?:\.|aa)?[ -](?P<mon>a+)\.?,?[ -](?P<Y>9999|99)",
    r"(?:(?P<wd>a+)\.?,? )?(?P<mon>a+)\.? (?P<d>99?)(?:aa)?,? (?P<Y>9999)",
]
SHAPES = [
    re.compile(p)
    for p in (
        r"(?P<e>9{10})(?:\.(?P<f>9+))?",
        r"(?P<ms>9{13})",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<ct>a| )(?P<H>99):?(?P<M>99)(?::?(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<w1>a+))?" + _ZONE + r")?",
        *(d + r"(?:" + _LINK + _CLOCK + _ZONE + r")?" for d in _DATES),
        *(d + _LINK + r"(?P<H>99?) ?(?P<hw>a) ?(?P<M>99)" + _ZONE for d in _DATES),
    )
]


def _parse(mask: str) -> dict[str, tuple[int, int]] | None:
    """Where each field of texts of this mask stands; None if no shape fits. Worked out once per mask."""
    for shape in SHAPES:
        m = shape.fullmatch(mask)
        if m:
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


parser_of = lru_cache(maxsize=65536)(_parse)


def masks(chars: np.ndarray) -> np.ndarray:
    """Code points with all digits made 9, all letters a, and any kind of blank a space."""
    out = chars.copy()
    out[(chars >= 48) & (chars <= 57)] = 57
    letter = ((chars >= 97) & (chars <= 122)) | ((chars >= 0xC0) & (chars < 0x250) & (chars != 0xD7) & (chars != 0xF7))
    out[letter] = 97
    out[(chars == 9) | (chars == 10) | (chars == 13) | (chars == 0xA0) | (chars == 0x202F)] = 32
    return out


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a field, and which one each row has."""
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    return np.unique(part.view(f"<U{span[1] - span[0]}").reshape(-1), return_inverse=True)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which dates exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last)
    yy, mm = y - (m <= 2), (m + 9) % 12
    era = yy // 400
    yoe = yy - era * 400
    doe = yoe * 365 + yoe // 4 - yoe // 100 + (153 * mm + 2) // 5 + d - 1
    return era * 146097 + doe - 719468, ok


def _fraction(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray | int:
    """Microseconds; further digits are cut off."""
    if span is None:
        return 0
    n = min(6, span[1] - span[0])
    return _number(chars, (span[0], span[0] + n)) * 10 ** (6 - n)


def _convert(chars: np.ndarray, at: dict[str, tuple[int, int]], zones: np.ndarray, day_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds, valid) of texts of one mask."""
    n = len(chars)
    ok = np.ones(n, dtype=bool)
    if "e" in at:
        return _number(chars, at["e"]) * 1_000_000 + _fraction(chars, at.get("f")), ok
    if "ms" in at:
        return _number(chars, at["ms"]) * 1000, ok
    y = _number(chars, at["Y"])
    if at["Y"][1] - at["Y"][0] == 2:
        y = y + 2000
    if "p" in at:
        p, q = _number(chars, at["p"]), _number(chars, at["q"])
        known = np.array([x is not None for x in day_first])
        first = np.array([bool(x) for x in day_first])
        m, d = np.where(first, q, p), np.where(first, p, q)
        ok &= known
    elif "mon" in at:
        words, which = _words(chars, at["mon"])
        m = np.array([MONTH_OF.get(w, 0) for w in words.tolist()], dtype=np.int64)[which]
        d = _number(chars, at["d"])
    else:
        m, d = _number(chars, at["m"]), _number(chars, at["d"])
    for field, allowed in (("wd", WEEKDAYS), ("cn", LINKS), ("ct", LINKS | {" "}), ("hw", {"h", "u"})):
        if field in at:
            words, which = _words(chars, at[field])
            ok &= np.array([w in allowed for w in words.tolist()])[which]
    days, exists = _days(y, m, d)
    ok &= exists
    hour, minute, second = (_number(chars, at[k]) if k in at else np.zeros(n, dtype=np.int64) for k in "HMS")
    ok &= (minute <= 59) & (second <= 59)
    offset = np.zeros(n, dtype=np.int64)
    fixed = np.zeros(n, dtype=bool)
    if "sg" in at:
        sign = np.where(chars[:, at["sg"][0]] == ord("-"), -1, 1)
        om = _number(chars, at["om"]) if "om" in at else 0
        oh = _number(chars, at["oh"])
        offset, fixed = sign * (oh * 3600 + om * 60), np.ones(n, dtype=bool)
        ok &= (oh <= 18) & (om <= 59)
    half = np.full(n, -1)
    for field in ("w1", "w2"):
        if field not in at:
            continue
        words, which = _words(chars, at[field])
        for i, w in enumerate(words.tolist()):
            rows = which == i
            plain = w.replace(".", "")
            if field == "w1" and plain in ("am", "pm"):
                half[rows] = plain == "pm"
            elif w in AFTER:
                continue
            elif "sg" in at:
                # the offset holds; a word beside it must still be a zone's
                for z in set(zones[rows].tolist()):
                    if not (w in UTC_WORDS or (z and w in zone_table(z).abbreviations)):
                        ok &= ~(rows & (zones == z))
            elif w in UTC_WORDS:
                fixed |= rows
            else:
                for z in set(zones[rows].tolist()):
                    own = rows & (zones == z)
                    found = zone_table(z).abbreviations.get(w) if z else None
                    if found is None:
                        ok &= ~own
                    else:
                        offset[own], fixed[own] = found, True
    twelve = half >= 0
    ok &= np.where(twelve, (hour >= 1) & (hour <= 12), hour <= 23)
    hour = np.where(twelve, hour % 12 + 12 * half, hour)
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    name = zones
    if "zn" in at:
        words, which = _words(chars, at["zn"])
        name = np.array([resolve(w) for w in words.tolist()], dtype=object)[which]
        ok &= np.array([x is not None for x in name])
    utc = wall - offset
    for z in set(name[~fixed & ok].tolist()):
        rows = ~fixed & ok & (name == z)
        if z is None:
            ok &= ~rows
        else:
            utc[rows] = zone_table(z).to_utc(wall[rows])
    return utc * 1_000_000 + _fraction(chars, at.get("f")), ok


def normalise_batch(texts: list[str | None], zones: list[str | None], day_first: list[bool | None]) -> list[int | None]:
    """UTC microseconds of each text, or None."""
    out: list[int | None] = [None] * len(texts)
    by_length: dict[int, list[int]] = {}
    clean = [t.strip().lower() if t else "" for t in texts]
    for i, t in enumerate(clean):
        if len(t) >= 6:  # no shape is shorter
            by_length.setdefault(len(t), []).append(i)
    zone = np.array([resolve(z) if z else None for z in zones], dtype=object)
    first = np.array(day_first, dtype=object)
    at_once = [(n, rows[k : k + step]) for n, rows in by_length.items() for step in (max(1, CELLS // n),) for k in range(0, len(rows), step)]
    for n, rows in at_once:
        index = np.array(rows)
        chars = np.frombuffer("".join(clean[i] for i in rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(rows), n)
        shape, which = np.unique(np.ascontiguousarray(masks(chars)).view(f"<U{n}").reshape(-1), return_inverse=True)
        for k, mask in enumerate(shape.tolist()):
            at = parser_of(mask) if n <= KEPT_MASK else _parse(mask)
            if at is None:
                continue
            of = np.flatnonzero(which == k)
            us, ok = _convert(chars[of], at, zone[index[of]], first[index[of]])
            for i, u in zip(index[of[ok]].tolist(), us[ok].tolist(), strict=True):
                out[i] = u
    return out


def utc_instants(df: DataFrame, ident: str, text: str, zone: str, day_first: str) -> DataFrame:
    """One UTC instant per row whose text names one: (ident, utc_us), microseconds since 1970-01-01.

    zone is the IANA name of the zone in which the row's source writes, day_first how it writes dates with
    slashes. Blanks around the text and letter case don't matter. An offset in the text holds before a zone
    name, a name or abbreviation (of the row's zone, or UTC and GMT) before the row's zone. Of a repeated
    hour the earlier instant counts; a skipped wall time is read with the offset before the change. A date
    alone is the start of its day. Digits only: 8 are a date, 10 seconds, 13 milliseconds. Two-digit years
    are 20xx. Fractions beyond microseconds are cut off.

    No row comes out for a text that is null, empty, not of a known shape or not a real date or time, nor for wall time without a known zone, nor a date with slashes without day_first.
    Repeated rows give repeated results; other columns are pruned. No shuffle.

    Each text becomes a mask of character classes; a mask is matched with the shapes once, which gives the
    places of its fields, and all texts of the mask are converted together as arrays. Zones are read from
    transition tables built once per process (zones.py, which carry the release of their rules); a task whose
    rules are of another release than the driver's is an error.
    """
    kind = dict(df.dtypes)[ident]
    rows = df.select(F.col(ident).alias("rec_id"), F.col(text).alias("t"), F.col(zone).alias("z"), F.col(day_first).alias("d")).where("t IS NOT NULL")
    version = tzdata_version()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        require_version(version)
        for b in batches:
            us = pa.array(normalise_batch(*(b.column(k).to_pylist() for k in (1, 2, 3))), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), us], names=["rec_id", "utc_us"]).filter(us.is_valid())

    return rows.mapInArrow(run, f"rec_id {kind}, utc_us bigint").withColumnRenamed("rec_id", ident)
