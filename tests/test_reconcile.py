import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from playbill import schemas
from playbill.operators import reconcile
from playbill.operators.keyed import BROADCAST_BYTES
from playbill.session import materialize

LONG = "x" * 256


def simulate(rows, gigs, venues):
    """The import row by row, as plainly as it can be written."""
    def key(title, date):
        return title.lower(), date.date()

    stored = {key(g["title"], g["date"]) for g in gigs}
    known = {v["name"].lower(): v["id"] for v in reversed(venues)}
    next_gig, next_venue = max([g["id"] for g in gigs], default=0), max([v["id"] for v in venues], default=0)
    outcomes, new_gigs, new_venues = {}, [], []
    for row in sorted(rows, key=lambda r: r["i"]):
        if row["title"] is not None and key(row["title"], row["date"]) in stored:
            outcomes[row["i"]] = "skipped"
            continue
        name = row["venue_name"]
        if len(name) > 255:
            outcomes[row["i"]] = "error"
            continue
        if name.lower() not in known:
            next_venue += 1
            known[name.lower()] = next_venue
            new_venues.append((next_venue, name))
        if not row["title"] or len(row["title"]) > 255:
            outcomes[row["i"]] = "error"
            continue
        next_gig += 1
        stored.add(key(row["title"], row["date"]))
        new_gigs.append((next_gig, row["title"], row["date"], known[name.lower()]))
        outcomes[row["i"]] = "created"
    return outcomes, new_gigs, new_venues


def case(seed, hot=False):
    rng = random.Random(seed)
    base = datetime(2026, 1, 1, 22, 30)
    titles = ["Act", "ACT", "act two", "Act Two", "Solo", LONG, None, ""]
    names = ["Unknown Venue", "unknown venue", "Hall", "HALL", "Six", "V" * 300]
    rows = [{"i": i, "title": "Act" if hot and i % 3 == 0 else rng.choice(titles),
             "date": base + timedelta(hours=0 if hot and i % 3 == 0 else rng.randrange(60)),
             "venue_name": "Unknown Venue" if hot and i % 2 == 0 else rng.choice(names),
             "description": None, "price": None, "url": "u"} for i in rng.sample(range(10_000), 300 if hot else 60)]
    gigs = [{"id": 10 + n, "title": t, "date": base + timedelta(hours=h)} for n, (t, h) in enumerate([("ACT two", 3), ("solo", 30)])]
    venues = [{"id": 4, "name": "Hall"}, {"id": 9, "name": "hall"}]
    return rows, gigs, venues


@pytest.mark.parametrize("seed, hot, limit", [(1, False, BROADCAST_BYTES), (2, False, 0), (3, True, 0)])
def test_matches_the_row_by_row_import(spark, seed, hot, limit):
    rows, gigs, venues = case(seed, hot)
    cand = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "i long, title string, date timestamp_ntz, venue_name string, description string, price string, url string")
    stored = spark.createDataFrame([(g["id"], g["title"], g["date"]) + (None,) * 5 + (False,) for g in gigs], schemas.GIG)
    places = spark.createDataFrame([(v["id"], v["name"], None, None, None) for v in venues], schemas.VENUE)
    got = reconcile.reconcile(cand, stored, places, materialize, width=1000, slices=8, broadcast_bytes=limit)
    outcomes, new_gigs, new_venues = simulate(rows, gigs, venues)
    assert {r.i: r.outcome for r in got.outcomes.collect()} == outcomes
    assert sorted((r.id, r.title, r.date, r.venue_id) for r in got.gigs.collect()) == new_gigs
    assert sorted((r.id, r.name) for r in got.venues.collect()) == new_venues
    counts = reconcile.outcome_counts(got.outcomes).first()
    assert counts.gigs_extracted == counts.gigs_created + counts.gigs_skipped + counts.errors == len(rows)


@pytest.mark.parametrize("sparse", [False, True])
def test_new_ids_of_sparse_records(spark, sparse):
    """Records numbered by hashes: ids follow their order, and no range holds more than twice the mean."""
    sizes = {}

    def stage(df, name):
        out = materialize(df, name)
        if name == "ranges":
            sizes[len(sizes)] = [r["count"] for r in out.groupBy(F.shiftright("_m", 33)).count().collect()]
        return out

    n = 20_000
    cand = spark.range(n).repartition(8).select(
        (F.xxhash64("id") if sparse else F.col("id")).alias("i"),
        F.concat(F.lit("Act "), "id").alias("title"), F.lit(datetime(2026, 2, 1)).cast("timestamp_ntz").alias("date"),
        F.concat(F.lit("Hall "), F.col("id") % 5000).alias("venue_name"),
        *[F.lit(None).cast("string").alias(c) for c in ("description", "price", "url")]).cache()
    got = reconcile.reconcile(cand, spark.createDataFrame([], schemas.GIG), spark.createDataFrame([], schemas.VENUE), stage)
    order = [r.title for r in cand.orderBy("i").collect()]
    assert [r.title for r in got.gigs.orderBy("id").collect()] == order
    assert sorted(r.id for r in got.gigs.collect()) == list(range(1, n + 1))
    assert sorted(r.id for r in got.venues.collect()) == list(range(1, 5001))
    assert sizes and all(len(s) == 1 or max(s) <= 2 * sum(s) / len(s) for s in sizes.values())


def test_reject_reasons(spark):
    rows = [("a", "2026-01-01", "€1", "u"), (None, "2026-01-01", None, None), (LONG, "2026-01-01", None, None),
            ("a", None, None, None), ("a", "2026-01-01", "p" * 51, None), ("a", "2026-01-01", None, "u" * 501),
            ("😀" * 128, "2026-01-01", None, None)]
    frame = spark.createDataFrame(rows, "title string, date string, price string, url string")
    ok, bad = reconcile.split_valid(frame, reconcile.gig_reason(frame.columns))
    assert ok.count() == 1 and "reason" not in ok.columns
    assert [r.reason for r in bad.collect()] == ["title_missing", "title_too_long", "date_missing", "price_too_long",
                                                "url_too_long", "title_too_long"]


def test_clear(spark):
    gigs = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, manual boolean")
    kept, deleted = reconcile.clear_non_manual(gigs)
    assert [r.id for r in kept.collect()] == [1] and deleted.first().deleted == 2


def test_payloads(spark):
    gig = spark.createDataFrame([("t", datetime(2026, 2, 15, 18, 0, 0, 5000), 3, "d", "€1", "u", "img")],
                                "title string, date timestamp_ntz, venue_id long, description string, price string, url string, image_url string")
    assert tuple(reconcile.to_gig_rows(gig).first()) == ("t", "2026-02-15T18:00:00.005Z", 3, "d", "€1", "u")
    venue = spark.createDataFrame([(1, "n", "a", None, "hood")], schemas.VENUE)
    assert reconcile.to_venue_rows(venue).columns == ["name", "address", "website"]


def test_stats_shape(spark):
    n = lambda k: spark.range(k)
    outcomes = spark.createDataFrame([("created",)] * 12 + [("skipped",)] * 3, "outcome string")
    stats = reconcile.sync_stats(n(20), n(8), n(7), outcomes)
    assert stats.columns == [f.name for f in schemas.SYNC_STATS.fields]
    assert tuple(stats.first()) == (20, 8, 7, 15, 12, 3, 0)
