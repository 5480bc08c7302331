"""Written selection rules as predicates: genre, city and event links."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.base import let

# Genres that are kept and genres that are skipped (fixed values).
KEEP_GENRES = ("rock", "metal", "indie", "alternative", "folk", "post-rock", "shoegaze",
               "dark", "goth", "post-punk", "experimental", "noise", "ambient")
EXTRACTION_GENRES = KEEP_GENRES + ("jazz",)
SKIP_GENRES = ("pop", "dance", "techno", "house", "rave", "edm", "hip-hop", "trap", "rap",
               "λαϊκά", "έντεχνο", "mainstream")

# Cities named as out of scope (fixed values); callers pass a longer list.
OTHER_CITIES = ("Thessaloniki", "Patras")

# Path parts that mark a single event, and those that mark other pages (fixed values).
EVENT_PATHS = (r"/event/", r"/concert/", r"/gig/", r"/show/", r"/\d+(/|\z)")
OTHER_PATHS = (r"/agenda/", r"/calendar/", r"/events(/|\z)", r"/archive/", r"/category/",
               r"/about(/|\z)", r"/contact(/|\z)")
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "youtube.com")


def any_word(words: Sequence[str]) -> str:
    """A pattern for any of the words with no letter on either side."""
    escaped = "|".join(w.replace("-", "[- ]?") for w in words)
    # The first letters tell at most places that none of the words stands there.
    first = "".join(sorted({w[:1] for w in words}))
    hint = f"(?=[{first}])" if all(w[:1].isalpha() and w[1:2] not in ("?", "*", "{") and "|" not in w for w in words) and words else ""
    return rf"(?i)(?:^|[^\p{{L}}]){hint}(?:{escaped})(?:[^\p{{L}}]|$)"


def genre_ok(text: Column, keep: Sequence[str] = EXTRACTION_GENRES,
             skip: Sequence[str] = SKIP_GENRES) -> Column:
    """Names a kept genre and no skipped one."""
    text = F.lower(text)
    return F.coalesce(text.rlike(any_word(keep)) & ~text.rlike(any_word(skip)), F.lit(False))


def city_ok(text: Column, other_cities: Sequence[str] = OTHER_CITIES) -> Column:
    """False when the text names another city; text that names none passes."""
    return ~F.coalesce(F.lower(text).rlike(any_word([c.lower() for c in other_cities])), F.lit(False))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _any_path(patterns: Sequence[str]) -> str:
    """A pattern for any of the path parts. Where all of them begin with a slash, it is tried at slashes only."""
    whole = "|".join(patterns)
    at_slash = all(re.match(r"/[a-z\\]", p) and "|" not in re.sub(r"\([^()]*\)", "", p) for p in patterns)
    return f"(?=/)(?:{whole})" if patterns and at_slash else whole


def is_event_link(url: Column, include: Sequence[str] = EVENT_PATHS,
                  exclude: Sequence[str] = OTHER_PATHS) -> Column:
    """The path looks like one event's page."""
    path = F.lower(url_path(url))
    return let(path, lambda p: p.rlike(_any_path(include)) & ~p.rlike(_any_path(exclude)))
