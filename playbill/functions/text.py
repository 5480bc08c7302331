"""Clean-up of the text fields of an event record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.base import SPACE, WS, present, trim_text, truncate

UNKNOWN_VENUE = "Unknown Venue"

# Price texts that mean "not stated" (fixed values).
NO_PRICE = ("", "N/A", "€", "EUR")


def normalize_price(raw: Column) -> Column:
    """`€n`, `Free`, `Sold Out` or null.

    The amount is the smallest number in the text, rounded down; a comma is a
    decimal point. Amounts that round to zero, or have more than 18 digits, are null; more than 15 digits lose their last ones.
    """
    text = trim_text(raw)
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+[.,]\d+|\d+)"), F.lit(1))
    lowest = F.array_min(F.transform(numbers, lambda n: F.translate(n, ",", ".").cast("double")))
    amount = F.floor(lowest)
    return (
        F.when(text.isNull() | text.isin(*NO_PRICE), F.lit(None).cast("string"))
        .when(text.rlike(f"(?i)sold{WS}*out"), "Sold Out")
        .when(text.rlike("(?i)free"), "Free")
        .when((lowest < 1e18) & (amount > 0), F.concat(F.lit("€"), amount.cast("string")))
    )


def price_eur(price: Column) -> Column:
    """The amount of a normalised `€n` price as an integer."""
    digits = F.regexp_extract(price, r"\A€(\d{1,18})\z", 1)
    return F.when(digits != "", digits.cast("bigint"))


def normalize_url(raw: Column) -> Column:
    """An absolute web address, or null when the text does not look like one."""
    text = trim_text(raw)
    return (
        F.when(text.rlike(r"(?i)\Ahttps?://"), text)
        .when(text.rlike(r"(?i)\Awww\."), F.concat(F.lit("https://"), text))
        .when(text.rlike(rf"\A[^{SPACE}]+\.[^{SPACE}]+"), F.concat(F.lit("https://"), text))
    )


def gig_url(ticket_url: Column, url: Column) -> Column:
    """Best link of a record from a batch: ticket link, then its own link, then empty."""
    return F.coalesce(normalize_url(ticket_url), normalize_url(url), F.lit(""))


def gig_url_on_page(ticket_url: Column, page_url: Column) -> Column:
    """Best link of a record from a single page: ticket link, then the page itself."""
    return F.coalesce(normalize_url(ticket_url), page_url)


def venue_or_default(name: Column) -> Column:
    return F.coalesce(present(name), F.lit(UNKNOWN_VENUE))


def name_key(name: Column) -> Column:
    """Case-insensitive identity of a name; both Greek lower sigmas count as one."""
    return F.translate(F.lower(name), "ς", "σ")


def eq_ci(a: Column, b: Column | str) -> Column:
    other = F.lit(b) if isinstance(b, str) else b
    return name_key(a) == name_key(other)


def clean_title(title: Column) -> Column:
    """The act alone: everything from `@` or ` at ` on is dropped."""
    return trim_text(F.regexp_replace(title, rf"(?is)({WS}*@|{WS}+at{WS}).*\z", ""))


def fit(text: Column, limit: int) -> Column:
    """Cut an over-long value down to a column limit (opt-in; the default is to reject)."""
    return truncate(text, limit)


def hit_text(url: Column, title: Column, description: Column) -> Column:
    """One search hit as the text block a selection prompt lists."""
    return F.concat(
        F.lit("URL: "), url,
        F.lit("\nTitle: "), F.coalesce(title, F.lit("undefined")),
        F.lit("\nDescription: "), F.coalesce(present(description), F.lit("N/A")),
    )


def numbered(items: Column) -> Column:
    """A list as numbered lines."""
    lines = F.transform(items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item))
    return F.array_join(lines, "\n")


def price_label(price: Column, url: Column, style: str = "desktop") -> Column:
    """What the listing shows in the price cell."""
    shown = present(price)
    blank = F.lit("—") if style == "desktop" else F.lit(None).cast("string")
    return F.when(present(url).isNotNull(), F.coalesce(shown, F.lit("Info"))).otherwise(F.coalesce(shown, blank))


def venue_label(name: Column, website: Column) -> Column:
    """The venue cell: a name, and a link when the venue has a site."""
    return F.when(name.isNotNull(), F.struct(name.alias("name"), present(website).alias("website")))


def strip_citations(text: Column) -> Column:
    """Drop citation and usage tags, then keep the JSON array in the text."""
    untagged = F.regexp_replace(text, r"(?is)<(citation|usage)>.*?</(?:citation|usage)>", "")
    return present(F.regexp_extract(untagged, r"(?s)\[.*\]", 0))
