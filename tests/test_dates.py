from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from playbill.functions import dates

# Text, and the UTC instant it stands for when local time is Athens.
PARSED = [
    ("2026-02-15", "2026-02-15T00:00"), ("2026-02", "2026-02-01T00:00"), ("2026", "2026-01-01T00:00"),
    ("2026-02-15T20:00:00", "2026-02-15T18:00"), ("2026-02-15T20:00", "2026-02-15T18:00"),
    ("2026-02-15t20:00", "2026-02-15T18:00"), ("2026-02-15 20:00", "2026-02-15T18:00"),
    ("2026-07-15T20:00:00", "2026-07-15T17:00"), ("2026-02-15T20:00:00Z", "2026-02-15T20:00"),
    ("2026-02-15T20:00:00+02:00", "2026-02-15T18:00"), ("2026-02-15T20:00:00-0530", "2026-02-16T01:30"),
    ("2026-02-15T24:00:00", "2026-02-15T22:00"), ("2026-02-15T24:01:00", None), ("2026-02-15T20:60:00", None),
    ("2026-03-29T03:30:00", "2026-03-29T01:30"), ("2026-10-25T03:30:00", "2026-10-25T00:30"),
    ("05/06/2026", "2026-05-05T21:00"), ("05-06-2026", "2026-05-05T21:00"), ("5/6/2026", "2026-05-05T21:00"),
    ("25/12/2026", "2026-12-24T22:00"), ("25-12-2026", "2026-12-24T22:00"), ("25/12/2026 20:00", None),
    ("2026-02-30", "2026-03-02T00:00"), ("2026-02-30T20:00:00", "2026-03-02T18:00"),
    ("2026-13-45", "2027-02-13T22:00"), ("99/99/2026", "2034-06-06T21:00"), ("02/32/2026", "2028-08-01T21:00"),
    ("2026-01-00", "2025-12-30T22:00"), ("2026-02-15T20", None), ("2026-13", None),
    ("15.02.2026", None), ("15", None), ("", None), (None, None), ("soon", None),
    ("Feb 15 2026 20:00", "2026-02-15T18:00"), ("February 15, 2026 8:30 PM", "2026-02-15T18:30"),
    ("15 February 2026", "2026-02-14T22:00"), ("Sun, 15 Feb 2026 20:00:00 GMT", "2026-02-15T20:00"),
    ("Sunday 15 February 2026 21:00", "2026-02-15T19:00"), ("2026/02/15", "2026-02-14T22:00"),
    ("2026/2/5 20:00", "2026-02-05T18:00"), ("2026/13/01", None), ("Feb 32 2026", None),
    ("1 May 2026 12:00 AM", "2026-04-30T21:00"), ("1 May 2026 13:30 pm", None), (" 2026-02-15", "2026-02-14T22:00"),
    ("05/06/26", "2026-05-05T21:00"), ("15-Feb-2026", "2026-02-14T22:00"), ("12 Sept 2026", "2026-09-11T21:00"),
]


def _at(text):
    return text and datetime.fromisoformat(text)


def test_flexible_dates(apply):
    assert apply(dates.parse_flexible_date, [t for t, _ in PARSED]) == [_at(w) for _, w in PARSED]


def test_fraction_and_zone(apply):
    assert apply(dates.parse_flexible_date, ["2026-02-15T20:00:00.123456"]) == [datetime(2026, 2, 15, 18, 0, 0, 123000)]
    assert apply(lambda c: dates.parse_flexible_date(c, "UTC"), ["2026-02-15T20:00"]) == [datetime(2026, 2, 15, 20)]


def test_day_first(apply):
    got = apply(lambda c: dates.parse_flexible_date(c, day_first=True), ["05/06/2026", "25/12/2026", "2026-02-15"])
    assert got == [_at("2026-06-04T21:00"), _at("2026-12-24T22:00"), _at("2026-02-15T00:00")]


@pytest.fixture(scope="module")
def edge(spark):
    times = [datetime(2026, 1, 31, 22, 30), datetime(2026, 2, 1, 21, 59), datetime(2026, 8, 11, 10), datetime(2026, 3, 23)]
    return spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")


def test_labels(edge):
    at = F.col("at")
    key = dates.month_key(at)
    rows = edge.select(dates.iso_utc(at), dates.utc_day(at), key, dates.month_label(key),
                       dates.day_label(at)["weekday"], dates.day_label(at)["day"]).collect()
    assert [tuple(r) for r in rows] == [
        ("2026-01-31T22:30:00.000Z", date(2026, 1, 31), "2026-02", "February", "Sun", "1st"),
        ("2026-02-01T21:59:00.000Z", date(2026, 2, 1), "2026-02", "February", "Sun", "1st"),
        ("2026-08-11T10:00:00.000Z", date(2026, 8, 11), "2026-08", "August", "Tue", "11th"),
        ("2026-03-23T00:00:00.000Z", date(2026, 3, 23), "2026-03", "March", "Mon", "23rd")]


def test_ordinals(apply):
    got = apply(dates.ordinal, list(range(1, 32)), "v int")
    assert got[:4] == ["1st", "2nd", "3rd", "4th"]
    assert got[10:13] == ["11th", "12th", "13th"]
    assert got[20:23] == ["21st", "22nd", "23rd"] and got[30] == "31st"


def test_range_label(apply):
    days = [date(2026, 1, 1), date(2026, 1, 15), date(2025, 12, 20)]
    assert apply(dates.date_range_label, days, "v date") == ["January 2026", "January-February 2026", "December-January 2026"]
    assert apply(lambda c: dates.date_range_label(c, 365), [date(2026, 5, 1)], "v date") == ["May 2026"]


def test_future_and_bounds(edge):
    assert edge.where(dates.is_future(F.col("at"), "2026-02-01")).count() == 3
    since, until = dates.day_bounds(F.lit("2026-02-01").cast("date"))
    assert edge.where((F.col("at") >= since) & (F.col("at") < until)).count() == 1
