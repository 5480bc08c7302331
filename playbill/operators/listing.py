"""Queries over the stored gigs and venues."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playbill.functions.dates import DEFAULT_ZONE, day_label, is_future, month_key, month_label
from playbill.functions.text import eq_ci, price_label, venue_label
from playbill.operators.keyed import lookup_join, page_by_range
from playbill.session import materialize

LISTING_LIMIT = 100
PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
DEEP_PAGE = 100_000  # rows a task may hold to serve a page; beyond, ranges find the same rows


def upcoming(gigs: DataFrame, as_of: str) -> DataFrame:
    """Gigs from the start of the UTC day `as_of` on.

    The bare range on `date` reaches the scan; on a stored table the month folders
    before it are not read at all.
    """
    rows = gigs.where(is_future(F.col("date"), as_of))
    return rows.where(F.col("month") >= as_of[:7]) if "month" in gigs.columns else rows


def populate_venue(gigs: DataFrame, venues: DataFrame, **skew) -> DataFrame:
    """Gigs with their venue's fields; gigs without a venue stay."""
    side = venues.select(
        F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), F.col("address").alias("venue_address"),
        F.col("website").alias("venue_website"), F.col("neighborhood").alias("venue_neighborhood"))
    return lookup_join(gigs, side, ["venue_id"], F.col("id"), **skew)


def populate_few(gigs: DataFrame, venues: DataFrame) -> DataFrame:
    """`populate_venue` for one page of at most MAX_PAGE_SIZE rows: only the venues it
    names are looked up, so neither table is shuffled."""
    wanted = gigs.where(F.col("venue_id").isNotNull()).select(F.col("venue_id").alias("id")).distinct()
    few = venues.join(F.broadcast(wanted), "id", "left_semi").select(
        F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), F.col("address").alias("venue_address"),
        F.col("website").alias("venue_website"), F.col("neighborhood").alias("venue_neighborhood"))
    return gigs.join(F.broadcast(few), "venue_id", "left")


def listing_order(rows: DataFrame, by: str = "date", descending: bool = False) -> DataFrame:
    """By one field, nulls first when rising; the id settles ties."""
    return rows.orderBy(*(F.col(c).desc() if descending else F.col(c).asc() for c in dict.fromkeys((by, "id"))))


def top(gigs: DataFrame, n: int = LISTING_LIMIT) -> DataFrame:
    return listing_order(gigs).limit(n)


def list_filter(gigs: DataFrame, filters: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Rows that meet all conditions: field -> (operator, value), with `eq`, `ne`,
    `gte`, `lte` and `eqi` (case-insensitive). Values take the field's type, so range
    conditions reach the scan. `ne` keeps nulls."""
    types = {f.name: f.dataType for f in gigs.schema.fields}
    for field, (op, value) in filters.items():
        column, typed = F.col(field), F.lit(value).cast(types[field])
        test: Column
        if op == "eqi":
            test = eq_ci(column, str(value))
        elif op == "eq":
            test = column == typed
        elif op == "ne":
            test = ~column.eqNullSafe(typed)
        elif op == "gte":
            test = column >= typed
        elif op == "lte":
            test = column <= typed
        else:
            raise ValueError(f"unknown operator: {op}")
        gigs = gigs.where(test)
    return gigs


def find_one(rows: DataFrame, key: int) -> DataFrame:
    return rows.where(F.col("id") == F.lit(key).cast("bigint"))


def page(rows: DataFrame, number: int = 1, size: int = PAGE_SIZE, by: str = "date", descending: bool = False) -> DataFrame:
    """One page of a table in the order of a field; a size above the maximum is an error.

    Near the start each task keeps the rows up to the page's end and no more. Deep
    pages find their keys by range first, so no task holds the rows before them.
    """
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page size {size} is not between 1 and {MAX_PAGE_SIZE}")
    offset = (max(number, 1) - 1) * size
    if offset + size <= DEEP_PAGE:
        return listing_order(rows, by, descending).offset(offset).limit(size)
    order = list(dict.fromkeys((by, "id")))
    keys = page_by_range(rows.select(*order), order, offset, size, materialize, descending)
    first = keys.orderBy("_row").first()
    if first is None:
        return rows.limit(0)
    # At most `size` keys; nulls count, and equal rows before the page are passed over.
    wanted = keys.select(*(F.col(c).alias(f"_{c}") for c in order)).distinct()
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(F.col(f"_{c}")) for c in order))
    found = rows.join(F.broadcast(wanted), same, "left_semi")
    return listing_order(found, by, descending).offset(first["_row"] - first["_first"]).limit(size)


def total(rows: DataFrame) -> DataFrame:
    """The number of rows of a whole list as a one-row result, also where a page is empty."""
    return rows.agg(F.count(F.lit(1)).alias("total"))


def list_venues(venues: DataFrame, filters: Mapping[str, tuple[str, object]] | None = None, number: int = 1,
                size: int = PAGE_SIZE, by: str = "name", descending: bool = False, count: bool = True) -> DataFrame:
    """One page of venues: filter, order, page, total."""
    rows = list_filter(venues, filters or {})
    out = page(rows, number, size, by, descending)
    return with_total(out, rows) if count else out


def with_total(page_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """The page with the number of rows the whole list has."""
    return page_rows.withColumn("total", rows.agg(F.count(F.lit(1)).alias("n")).scalar())


def list_gigs(
    gigs: DataFrame,
    venues: DataFrame,
    filters: Mapping[str, tuple[str, object]] | None = None,
    number: int = 1,
    size: int = PAGE_SIZE,
    count: bool = True,
    by: str = "date",
    descending: bool = False,
) -> DataFrame:
    """One page of gigs with venues: filter, order, page, populate, total."""
    rows = list_filter(gigs, filters or {})
    out = populate_few(page(rows, number, size, by, descending), venues)
    return with_total(out, rows) if count else out


def month_counts(gigs: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """Number of gigs and first date per display month."""
    key = month_key(F.col("date"), tz)
    return (gigs.groupBy(key.alias("month_key"))
            .agg(F.count(F.lit(1)).alias("gigs"), F.min("date").alias("first_date")))


def by_month(listing: DataFrame, tz: str = DEFAULT_ZONE) -> DataFrame:
    """A listing as month groups: flat rows with the group's label, its rank by first
    appearance and the row's place in the group. Only the months are ranked in one task."""
    keyed = listing.withColumn("month_key", month_key(F.col("date"), tz))
    inside = W.partitionBy("month_key").orderBy("date", "id")
    months = keyed.select("month_key").distinct().select(
        F.col("month_key").alias("_month"), F.row_number().over(W.orderBy("month_key")).alias("group_no"))
    return (keyed.join(months, keyed["month_key"].eqNullSafe(F.col("_month")), "left").drop("_month")
            .withColumn("month_label", month_label(F.col("month_key")))
            .withColumn("place", F.row_number().over(inside)))


def upcoming_listing(gigs: DataFrame, venues: DataFrame, as_of: str, tz: str = DEFAULT_ZONE,
                     n: int = LISTING_LIMIT) -> DataFrame:
    """The next `n` gigs with venue, labels and month groups; more than MAX_PAGE_SIZE is an error.

    The limit comes before the venue lookup: the scan keeps `n` rows per task and
    everything after works on those `n`.
    """
    if not 1 <= n <= MAX_PAGE_SIZE:
        raise ValueError(f"{n} rows are not between 1 and {MAX_PAGE_SIZE}")
    rows = populate_few(top(upcoming(gigs, as_of), n), venues)
    label = day_label(F.col("date"), tz)
    return by_month(
        rows.withColumn("weekday", label["weekday"])
        .withColumn("day", label["day"])
        .withColumn("price_label", price_label(F.col("price"), F.col("url")))
        .withColumn("venue_link", venue_label(F.col("venue_name"), F.col("venue_website"))),
        tz)
