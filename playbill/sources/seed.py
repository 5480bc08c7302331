"""Fixed inputs: search queries, extra source pages and sample rows."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import schemas
from playbill.functions.dates import DEFAULT_ZONE

# Search queries of one run (fixed values): text, country, language, extra snippets.
SEARCH_QUERIES = [
    ("συναυλίες Αθήνα 2026", "GR", "el", True),
    ("rock metal alternative concerts Athens Greece 2026", "GR", None, True),
    ("live music Athens venues upcoming shows 2026", "GR", None, True),
]

# Source pages that are always read (fixed values).
EXTRA_URLS = [
    "https://www.more.com/music/concerts/",
    "https://www.more.com/gr-el/tickets/music/",
]

# Sample venues (fixed values): name, address, website, neighborhood.
SAMPLE_VENUES = [
    ("Six Dogs", "Avramiotou 6-8, Monastiraki", "https://sixdogs.gr", "Monastiraki"),
    ("Romantso", "Anaxagora 3-5, Omonoia", "https://romantso.gr", "Omonoia"),
    ("Death Disco", "Ogigou 6, Gazi", "https://deathdisco.gr", "Gazi"),
    ("Fuzz Club", "Pireos 209, Tavros", "https://fuzzclub.gr", "Tavros"),
    ("Gazarte", "Voutadon 32-34, Gazi", "https://gazarte.gr", "Gazi"),
]

# Sample gigs (fixed values): title, months ahead, day (days ahead in this month,
# day of the month in the next), local time, price, description, venue ordinal.
SAMPLE_GIGS = [
    ("Jazz Night with The Athenians", 0, 3, "21:00", "€10", "An evening of smooth jazz", 0),
    ("Punk Rock Showdown", 0, 5, "22:00", "€8", "Local punk bands take the stage", 2),
    ("Electronic Dreams", 0, 7, "23:00", "€15", "Techno and house music night", 1),
    ("Acoustic Sessions", 0, 10, "20:00", "Free", "Intimate acoustic performances", 0),
    ("Metal Mayhem", 0, 14, "21:30", "€12", "Heavy metal night", 3),
    ("Indie Showcase", 1, 5, "21:00", "€10", "Emerging indie artists", 4),
    ("Blues & Soul Evening", 1, 10, "20:30", "€15", "Classic blues and soul covers", 0),
    ("DJ Battle Royale", 1, 15, "23:00", "€8", "DJs compete for the crown", 1),
    ("Folk Festival", 1, 20, "19:00", "Free", "Traditional and contemporary folk", 4),
    ("Rock Legends Tribute", 1, 25, "21:00", "€20", "Tribute to classic rock bands", 3),
]


def search_queries(spark: SparkSession, rows=SEARCH_QUERIES) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schemas.SEARCH_QUERY)


def extra_urls(spark: SparkSession, urls=EXTRA_URLS) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string")


def seed(spark: SparkSession, as_of: date, tz: str = DEFAULT_ZONE) -> tuple[DataFrame, DataFrame]:
    """Sample venues and gigs dated relative to `as_of`; times are local to `tz`."""
    next_month = (as_of.replace(day=1) + timedelta(days=32)).replace(day=1)
    venues = spark.createDataFrame(
        [(i + 1, *row) for i, row in enumerate(SAMPLE_VENUES)], schemas.VENUE)
    rows = []
    for i, (title, ahead, day, clock, price, description, venue) in enumerate(SAMPLE_GIGS):
        on = next_month + timedelta(days=day - 1) if ahead else as_of + timedelta(days=day)
        rows.append((i + 1, title, datetime.combine(on, time.fromisoformat(clock)), clock, price,
                     description, None, venue + 1, False))
    gigs = spark.createDataFrame(rows, schemas.GIG)
    return venues, gigs.withColumn("date", F.convert_timezone(F.lit(tz), F.lit("UTC"), "date"))


def seed_if_empty(venues: DataFrame, gigs: DataFrame, as_of: date,
                  tz: str = DEFAULT_ZONE) -> tuple[DataFrame, DataFrame]:
    """The stored tables, plus the samples when no venue is stored."""
    new_venues, new_gigs = seed(venues.sparkSession, as_of, tz)
    empty = venues.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    return (venues.unionByName(new_venues.where(empty)),
            gigs.unionByName(new_gigs.where(empty)))
