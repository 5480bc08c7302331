from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playbill import schemas
from playbill.operators import listing
from playbill.sources import seed


@pytest.fixture(scope="module")
def store(spark):
    return seed.seed(spark, date(2026, 2, 20))


def test_seed(store):
    venues, gigs = store
    rows = gigs.orderBy("id").collect()
    assert venues.count() == 5 and len(rows) == 10
    assert rows[0].date == datetime(2026, 2, 23, 19) and rows[5].date == datetime(2026, 3, 5, 19)
    assert [r.venue_id - 1 for r in rows] == [0, 2, 1, 0, 3, 4, 0, 1, 4, 3]
    assert [r.price for r in rows] == ["€10", "€8", "€15", "Free", "€12", "€10", "€15", "€8", "Free", "€20"]


def test_seed_only_when_empty(spark, store):
    venues, gigs = store
    empty = seed.seed_if_empty(venues.limit(0), gigs.limit(0), date(2026, 1, 1))
    assert (empty[0].count(), empty[1].count()) == (5, 10)
    kept = seed.seed_if_empty(venues.limit(1), gigs.limit(0), date(2026, 1, 1))
    assert (kept[0].count(), kept[1].count()) == (1, 0)


def test_upcoming_listing(store):
    venues, gigs = store
    rows = listing.upcoming_listing(gigs, venues, "2026-02-25").orderBy("date", "id").collect()
    assert [r.title for r in rows][:3] == ["Punk Rock Showdown", "Electronic Dreams", "Acoustic Sessions"]
    assert rows[0].month_label == "February" and rows[0].day == "25th" and rows[0].weekday == "Wed"
    assert rows[0].venue_link.website == "https://deathdisco.gr" and rows[0].price_label == "€8"
    assert [(r.group_no, r.place) for r in rows][:4] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows[2].month_label == "March" and len(rows) == 9


def test_listing_without_venue(spark, store):
    venues, gigs = store
    lonely = gigs.withColumn("venue_id", F.when(F.col("id") == 1, None).otherwise(F.col("venue_id")))
    rows = {r.id: r.venue_name for r in listing.populate_few(lonely, venues).collect()}
    assert rows[1] is None and rows[2] == "Death Disco" and len(rows) == 10
    assert {r.id: r.venue_name for r in listing.populate_venue(lonely, venues, broadcast_bytes=0).collect()} == rows


@pytest.fixture(scope="module")
def many(spark):
    start = datetime(2026, 1, 1)
    rows = [(i, f"T{i % 7}", start + timedelta(hours=i % 50), None, None, None, None, i % 3, [True, False, None][i % 3])
            for i in range(260)]
    return rows, spark.createDataFrame(rows, schemas.GIG)


@pytest.mark.parametrize("number, size, want", [(1, 25, 25), (11, 25, 10), (12, 25, 0), (1, 500, 100), (0, 25, 25), (2, 0, 1)])
def test_pages(many, number, size, want):
    rows, frame = many
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    if not 1 <= size <= 100:
        with pytest.raises(ValueError, match="page size"):
            listing.page(frame, number, size)
        return
    step = size
    begin = (max(number, 1) - 1) * step
    got = [r.id for r in listing.page(frame, number, size).collect()]
    assert got == [r[0] for r in ordered[begin:begin + step]] and len(got) == want


def test_deep_pages_agree(many, monkeypatch):
    _, frame = many
    near = [r.id for r in listing.page(frame, 5, 20).collect()]
    monkeypatch.setattr(listing, "DEEP_PAGE", 10)
    assert [r.id for r in listing.page(frame, 5, 20).collect()] == near


def test_deep_pages_keep_nulls_and_ties(spark, monkeypatch):
    at = datetime(2026, 1, 1)
    rows = [(k, None if k % 3 == 0 else at) for k in range(8)] + [(7, at)] * 6
    frame = spark.createDataFrame(rows, "id long, date timestamp_ntz").repartition(3)
    want = sorted(((r[1] is not None, r[1] or at, r[0]) for r in rows))
    monkeypatch.setattr(listing, "DEEP_PAGE", 0)
    for number in range(1, 7):
        got = [(r.date is not None, r.date or at, r.id) for r in listing.page(frame, number, 3).collect()]
        assert got == want[3 * number - 3 : 3 * number]


def test_venues_by_name(store, monkeypatch):
    venues, _ = store
    names = sorted((r.name for r in venues.collect()), reverse=True)
    near = listing.list_venues(venues, number=2, size=2, descending=True).collect()
    assert [r.name for r in near] == names[2:4] and {r.total for r in near} == {len(names)}
    monkeypatch.setattr(listing, "DEEP_PAGE", 0)
    assert [r.name for r in listing.list_venues(venues, number=2, size=2, descending=True, count=False).collect()] == names[2:4]
    assert listing.total(venues.where("false")).first().total == 0


def test_too_many_rows_is_an_error(spark, store):
    with pytest.raises(ValueError, match="300 rows"):
        listing.upcoming_listing(store[1], store[0], "2026-01-01", n=300)


def test_list_gigs(spark, many, store):
    rows, frame = many
    venues, _ = store
    got = listing.list_gigs(frame, venues, {"title": ("eqi", "t3"), "manual": ("ne", True)}, size=10).collect()
    match = [r for r in rows if r[1] == "T3" and r[8] is not True]
    assert len(got) == 10 and {r.total for r in got} == {len(match)}
    assert "total" not in listing.list_gigs(frame, venues, count=False).columns
    with pytest.raises(ValueError):
        listing.list_filter(frame, {"title": ("like", "x")})


def test_filters(many):
    rows, frame = many
    some = listing.list_filter(frame, {"id": ("gte", 10), "venue_id": ("eq", 1), "date": ("lte", "2026-01-01 12:00:00")})
    assert some.count() == sum(r[0] >= 10 and r[7] == 1 and r[2] <= datetime(2026, 1, 1, 12) for r in rows)
    assert listing.find_one(frame, 7).first().title == "T0"


def test_range_reaches_the_scan(spark, many, tmp_path):
    many[1].write.parquet(str(tmp_path / "g"))
    plan = listing.upcoming(spark.read.parquet(str(tmp_path / "g")), "2026-01-02").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in text and "ReadSchema: struct<id:bigint,date:timestamp_ntz>" in text
