from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.operators.timestamps import SHAPES, normalise_batch, parser_of, utc_instants
from quillspan.operators.zones import tzdata_version, zone_table

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def us(*a, tz="UTC", **k):
    return (datetime(*a, **k, tzinfo=ZoneInfo(tz)) - EPOCH) // timedelta(microseconds=1)


def one(text, zone="Europe/Berlin", day_first=True):
    return normalise_batch([text], [zone], [day_first])[0]


CASES = [
    ("2023-01-14", us(2023, 1, 14, tz="Europe/Berlin")),
    ("20230114", us(2023, 1, 14, tz="Europe/Berlin")),
    ("  2023-01-14T02:20:55Z\n", us(2023, 1, 14, 2, 20, 55)),
    ("2023-01-14t02:20:55z", us(2023, 1, 14, 2, 20, 55)),
    ("20230110T210945Z", us(2023, 1, 10, 21, 9, 45)),
    ("1673410267", 1673410267_000000),
    ("1673423521.636", 1673423521_636000),
    ("1673753514353", 1673753514_353000),
    ("2023-01-11 09:25:56.487237+00:00", us(2023, 1, 11, 9, 25, 56, 487237)),
    ("2023-01-13T19:47:01,272-05:00", us(2023, 1, 14, 0, 47, 1, 272000)),
    ("2023-01-12T21:42:08-03", us(2023, 1, 13, 0, 42, 8)),
    ("2023-01-13T22:47:40+0530", us(2023, 1, 13, 17, 17, 40)),
    ("2023-01-12 15:18:02 +01:00", us(2023, 1, 12, 14, 18, 2)),
    ("Sun, 15 Jan 2023 09:20:25 GMT", us(2023, 1, 15, 9, 20, 25)),
    ("Sun, 15 Jan 2023 09:20:25 CET", us(2023, 1, 15, 8, 20, 25)),
    ("Sun, 15 Jan 2023 09:20:25 EST", None),  # not of this source's zone
    ("10 Jan 23 06:47 -0800", us(2023, 1, 10, 14, 47)),
    ("11 janvier 2023 à 08h21", us(2023, 1, 11, 8, 21, tz="Europe/Berlin")),
    ("11 AOÛT 2023 À 08H21", us(2023, 8, 11, 8, 21, tz="Europe/Berlin")),
    ("8. März 2023, 13:58 Uhr", us(2023, 3, 8, 13, 58, tz="Europe/Berlin")),
    ("January 10, 2023 at 7:34 pm", us(2023, 1, 10, 19, 34, tz="Europe/Berlin")),
    ("January 10, 2023 at 12:34 a.m.", us(2023, 1, 10, 0, 34, tz="Europe/Berlin")),
    ("12.02.2023 04:10", us(2023, 2, 12, 4, 10, tz="Europe/Berlin")),
    ("2023-01-10T09:59:42[Asia/Tokyo]", us(2023, 1, 10, 9, 59, 42, tz="Asia/Tokyo")),
    ("2023-01-10T09:59:42[america/new_york]", us(2023, 1, 10, 9, 59, 42, tz="America/New_York")),
    ("2023-01-12T11:47:03+05:00[Europe/Berlin]", us(2023, 1, 12, 6, 47, 3)),
    ("2023-01-12T11:47:03[No/Where]", None),
    ("10 Jan 2023", us(2023, 1, 10, tz="Europe/Berlin")),
    # the hour that comes twice: the earlier instant; the hour that is skipped: the offset before the change
    ("2023-10-29 02:30", us(2023, 10, 29, 0, 30)),
    ("2023-03-26 02:30", us(2023, 3, 26, 1, 30)),
    ("2023-10-29 02:30:00 CET", us(2023, 10, 29, 1, 30)),
    ("30 Feb 2025 10:00 GMT", None),
    ("2025-06-31", None),
    ("2025-13-41T25:61:00Z", None),
    ("0000-00-00 00:00:00", None),
    ("13:00 pm", None),
    ("January 10, 2023 at 13:34 pm", None),
    ("2024-02-29", us(2024, 2, 29, tz="Europe/Berlin")),
    ("2023-02-29", None),
    ("yesterday", None),
    ("", None),
    (None, None),
    ("9" * 5000, None),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_forms(text, expected):
    assert one(text) == expected


def test_slashes_follow_the_source():
    assert one("03/04/2023 08:00", "UTC", True) == us(2023, 4, 3, 8)
    assert one("03/04/2023 08:00", "UTC", False) == us(2023, 3, 4, 8)
    assert one("13/04/2023 08:00", "UTC", False) is None
    assert one("03/04/2023 08:00", "UTC", None) is None


def test_wall_time_needs_a_zone():
    assert one("2023-01-14 10:00", None) is None
    assert one("2023-01-14 10:00 UTC", None) == us(2023, 1, 14, 10)
    assert one("2023-01-14 10:00", "Not/AZone") is None


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2036, 12, 31)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Europe/London", "Africa/Casablanca"]))
def test_wall_time_equals_the_standard_library(t, zone):
    t = t.replace(microsecond=0)
    expected = (t.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC) - EPOCH) // timedelta(microseconds=1)
    assert one(t.strftime("%Y-%m-%d %H:%M:%S"), zone) == expected


def test_a_mask_is_parsed_once():
    parser_of.cache_clear()
    normalise_batch(["2023-01-14", "2022-05-06", "1999-12-31"] * 100, ["UTC"] * 300, [True] * 300)
    assert parser_of.cache_info().misses == 1
    assert len(SHAPES) > 3 and tzdata_version()
    assert len(zone_table("Europe/Berlin").at) > 50


def test_operator_on_rows(spark):
    rows = [(1, "2023-01-14", "UTC", True, "x"), (1, "2023-01-14", "UTC", True, "x"), (2, None, "UTC", True, None), (3, "", None, None, "y"), (None, "2023-01-14", "UTC", None, "z")]
    df = spark.createDataFrame(rows, "rec_id long, published_at string, tz string, first boolean, t string")
    got = sorted((tuple(r) for r in utc_instants(df, "rec_id", "published_at", "tz", "first").collect()), key=str)
    assert got == sorted([(1, us(2023, 1, 14)), (1, us(2023, 1, 14)), (None, us(2023, 1, 14))], key=str)
    assert utc_instants(df.limit(0), "rec_id", "published_at", "tz", "first").collect() == []


def test_long_texts_are_read_whole():
    """No length ends a text: zone names, fractions and spelled dates of 65 to 120 characters and more."""
    texts = {
        "2026-09-30 11:59:59.123456-03:00 [America/Argentina/Buenos_Aires]": "2026-09-30T14:59:59.123456",
        "30 September 2026 11:59:59 -03:00 [America/Argentina/Buenos_Aires]": "2026-09-30T14:59:59",
        "Wednesday, 30 September 2026 11:59:59.123456789 [America/Argentina/Buenos_Aires]": "2026-09-30T14:59:59.123456",
        "2026-09-30 11:59:59." + "1" * 100 + "Z": "2026-09-30T11:59:59.111111",
        "2026-09-30 11:59:59." + "1" * 3000 + "Z": "2026-09-30T11:59:59.111111",
        "1790000000." + "0" * 90 : "2026-09-21T14:13:20",
    }
    got = normalise_batch(list(texts), ["UTC"] * len(texts), [True] * len(texts))
    for (text, want), us in zip(texts.items(), got, strict=True):
        assert us is not None, text
        assert datetime(1970, 1, 1) + timedelta(microseconds=us) == datetime.fromisoformat(want), text
    assert normalise_batch(["x" * 200_000, "9" * 70, " " * 500], ["UTC"] * 3, [True] * 3) == [None] * 3


def test_daylight_saving_goes_on_after_the_table():
    zone = ZoneInfo("Europe/Berlin")
    for year in (2099, 2100, 2101, 2437, 2499, 2500, 2873, 4100):
        for month in (1, 3, 7, 10, 12):
            wall = datetime(year, month, 29, 12, 30)
            us = normalise_batch([wall.isoformat()], ["Europe/Berlin"], [True])[0]
            want = wall.replace(tzinfo=zone).astimezone(UTC).replace(tzinfo=None)
            assert datetime(1970, 1, 1) + timedelta(microseconds=us) == want, wall
