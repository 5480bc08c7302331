"""Matching new records against the stored gigs and venues.

The rules follow a row-by-row import: rows come in order of `i`; a row whose
(title, UTC day) is already stored, or was stored earlier in the same run, is
skipped; otherwise its venue is found or made and the gig is stored; a row that
breaks a column limit is an error and stores no gig.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.base import present, utf16_length
from playbill.functions.dates import iso_utc, utc_day
from playbill.functions.text import name_key
from playbill.operators.keyed import id_range, lookup_join, number_rows, number_sorted
from playbill.schemas import GIG_LIMITS, VENUE_LIMITS
from playbill.session import materialize

CREATED, SKIPPED, ERROR = "created", "skipped", "error"

Stage = Callable[[DataFrame, str], DataFrame]


def same(df: DataFrame, name: str) -> DataFrame:
    """The stage that keeps everything one lazy plan."""
    return df


def limit_reason(required: list[str], limits: Mapping[str, int], columns: list[str]) -> Column:
    """Why the store would refuse a row, or null."""
    reason = F.lit(None).cast("string")
    for name in reversed([c for c in limits if c in columns]):
        reason = F.when(utf16_length(F.col(name)) > limits[name], f"{name}_too_long").otherwise(reason)
    for name in reversed(required):
        value = F.col(name)
        missing = value.isNull() | (value.cast("string") == "")
        reason = F.when(missing, f"{name}_missing").otherwise(reason)
    return reason


def gig_reason(columns: list[str]) -> Column:
    return limit_reason(["title", "date"], GIG_LIMITS, columns)


def venue_reason(name: str = "name") -> Column:
    too_long = utf16_length(F.col(name)) > VENUE_LIMITS["name"]
    return (F.when(present(F.col(name)).isNull(), "venue_missing")
            .when(too_long, "venue_too_long"))


def split_valid(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows the store accepts, and the refused ones with their reason."""
    judged = rows.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def to_gig_rows(gigs: DataFrame) -> DataFrame:
    """The fields of a stored gig, with the date as ISO text; the image is not kept."""
    return gigs.select("title", iso_utc(F.col("date")).alias("date"), F.col("venue_id").alias("venue"),
                       "description", "price", "url")


def to_venue_rows(venues: DataFrame) -> DataFrame:
    return venues.select("name", "address", "website")


@dataclass
class Reconciled:
    gigs: DataFrame      # new gigs, in the stored shape
    venues: DataFrame    # new venues, in the stored shape
    outcomes: DataFrame  # every candidate with outcome and reason


def gig_outcomes(candidates: DataFrame, gigs: DataFrame, stage: Stage = same, **skew) -> DataFrame:
    """Outcome and reason of every candidate.

    Each key is first reduced to one row (its first storable index, and whether it
    is stored), which partial aggregation keeps small however hot the key is; the
    candidates then look that row up. Staging that table also gives its true size.
    """
    reason = F.coalesce(F.when(F.col("i").isNull(), "no_index"), gig_reason(candidates.columns), venue_reason("venue_name"))
    keyed = (candidates.withColumn("reason", reason)
             .withColumn("title_key", name_key(F.col("title")))
             .withColumn("day", utc_day(F.col("date"))))
    keys = keyed.groupBy("title_key", "day").agg(
        F.min(F.when(F.col("reason").isNull(), F.col("i"))).alias("first_valid"),
        F.count(F.lit(1)).alias("n"))
    if "month" in gigs.columns:
        # Stored by month folder: the folders of other months are not read.
        months = keyed.where(F.col("day").isNotNull()).select(F.date_format("day", "yyyy-MM").alias("month")).distinct()
        gigs = gigs.join(months, "month", "left_semi")
    stored = gigs.select(name_key(F.col("title")).alias("title_key"), utc_day(F.col("date")).alias("day"),
                         F.lit(True).alias("stored")).distinct()
    known = stage(keys.join(stored, ["title_key", "day"], "left"), "keys")
    counts = known.select("title_key", "day", "n")
    judged = lookup_join(keyed, known.drop("n"), ["title_key", "day"], F.col("i"), counts, **skew)
    outcome = (F.when(F.col("stored"), SKIPPED)
               .when(F.col("i") > F.col("first_valid"), SKIPPED)
               .when(F.col("i") == F.col("first_valid"), CREATED)
               .otherwise(ERROR))
    return judged.withColumn("outcome", outcome).drop("stored", "first_valid")


def _numbered(df: DataFrame, key: str, width: int | None, stage: Stage) -> DataFrame:
    """`no` in order of a unique `key`: in sampled ranges, or in ranges of `width` where the key is dense."""
    if width is None:
        return number_sorted(df, [key], "no", stage)
    return number_rows(df, [key], id_range(F.col(key), width), "no")


def match_venues(
    outcomes: DataFrame,
    venues: DataFrame,
    stage: Stage = materialize,
    width: int | None = None,
) -> DataFrame:
    """One row per venue named by a created or failed row: key, name, id, is_new.

    A venue that is not stored is named as first seen and takes the next free id in
    order of appearance.
    """
    named = (outcomes.where((F.col("outcome") != SKIPPED) & venue_reason("venue_name").isNull())
             .groupBy(name_key(F.col("venue_name")).alias("venue_key"))
             .agg(F.min("i").alias("first_i"), F.min_by("venue_name", "i").alias("name")))
    stored = (venues.groupBy(name_key(F.col("name")).alias("venue_key"))
              .agg(F.min("id").alias("stored_id")))
    matched = stage(named.join(stored, "venue_key", "left"), "matched")
    old = matched.where(F.col("stored_id").isNotNull()).select(
        "venue_key", "name", F.col("stored_id").alias("venue_id"), F.lit(False).alias("is_new"))
    fresh = _numbered(matched.where(F.col("stored_id").isNull()), "first_i", width, stage)
    new = fresh.select("venue_key", "name", (_top_id(venues) + F.col("no")).alias("venue_id"),
                       F.lit(True).alias("is_new"))
    return old.unionByName(new)


def _top_id(stored: DataFrame) -> Column:
    return stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()


def reconcile(
    candidates: DataFrame,
    gigs: DataFrame,
    venues: DataFrame,
    stage: Stage = materialize,
    width: int | None = None,
    **skew,
) -> Reconciled:
    """New gigs, new venues and outcomes for candidates with a unique order `i`.

    `stage(df, name)` writes an intermediate table and returns it re-read. New ids follow the
    highest stored id in order of `i`, so a repeated run makes the same ones; they are given in
    sampled ranges of even size, so `i` may be dense, sparse or a hash; a `width` takes fixed ranges of a dense `i`.
    """
    outcomes = stage(gig_outcomes(candidates, gigs, stage, **skew), "outcomes")
    matched = stage(match_venues(outcomes, venues, stage, width), "venues")

    new_venues = matched.where("is_new").select(
        F.col("venue_id").alias("id"), "name",
        *[F.lit(None).cast("string").alias(c) for c in ("address", "website", "neighborhood")])

    created = (_numbered(outcomes.where(F.col("outcome") == CREATED), "i", width, stage)
               .withColumn("venue_key", name_key(F.col("venue_name"))))
    placed = lookup_join(created, matched.select("venue_key", "venue_id"), ["venue_key"], F.col("i"), **skew)
    new_gigs = placed.select(
        (_top_id(gigs) + F.col("no")).alias("id"), "title", "date",
        F.lit(None).cast("string").alias("time_display"), "price", "description", "url", "venue_id",
        F.lit(False).alias("manual"))
    return Reconciled(new_gigs, new_venues, outcomes)


def not_manual() -> Column:
    return ~F.coalesce(F.col("manual"), F.lit(False))


def clear_non_manual(gigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gigs that survive a clear, and the number of deleted ones."""
    return gigs.where(~not_manual()), gigs.agg(F.count_if(not_manual()).alias("deleted"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Counters of the storing step, in one pass."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("gigs_extracted"),
        F.count_if(F.col("outcome") == CREATED).alias("gigs_created"),
        F.count_if(F.col("outcome") == SKIPPED).alias("gigs_skipped"),
        F.count_if(F.col("outcome") == ERROR).alias("errors"))


def sync_stats(hits: DataFrame, sources: DataFrame, details: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The seven counters of a run as one row."""
    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    return outcome_counts(outcomes).select(
        size(hits).alias("search_results"), size(sources).alias("filtered_urls"),
        size(details).alias("scraped_urls"),
        "gigs_extracted", "gigs_created", "gigs_skipped", "errors")
