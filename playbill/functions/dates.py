"""Date parsing and date labels. Instants are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playbill.functions.base import let

DEFAULT_ZONE = "Europe/Athens"

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_YEAR = r"(\d{4}|\d{2})"
# hour, minute, second, fraction, am/pm, zone
_TIME = (r"(?:[\s,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(?:\s*([ap]m))?"
         r"(?:\s*(z|gmt|utc|[+-]\d{2}:?\d{2}))?)?")

# Accepted shapes, tried in order: (kind, pattern, replacement). The replacement
# rewrites the text as kind;year;month;day;hour;minute;second;fraction;am/pm;zone.
_SHAPES = [
    ("iso", r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", "$1;$2;$3;;;;;;z"),
    ("iso", r"(\d{4})-(\d{2})-(\d{2})[tT](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(z|Z|[+-]\d{2}:?\d{2})?",
     "$1;$2;$3;$4;$5;$6;$7;;$8"),
    ("loose", rf"(?i)\s*(\d{{4}})[/-](\d{{1,2}})[/-](\d{{1,2}}){_TIME}\s*", "$1;$2;$3;$4;$5;$6;$7;$8;$9"),
    ("numeric", rf"(?i)\s*(\d{{1,2}})[/-](\d{{1,2}})[/-]{_YEAR}{_TIME}\s*", "$3;$1;$2;$4;$5;$6;$7;$8;$9"),
    ("loose", rf"(?i)\s*{_WEEKDAY}{_MONTH}[\s-]+(\d{{1,2}})[,\s-]+{_YEAR}{_TIME}\s*",
     "$3;$1;$2;$4;$5;$6;$7;$8;$9"),
    ("loose", rf"(?i)\s*{_WEEKDAY}(\d{{1,2}})[\s-]+{_MONTH}[,\s-]+{_YEAR}{_TIME}\s*",
     "$3;$2;$1;$4;$5;$6;$7;$8;$9"),
]
# Shapes whose fields may overflow into the next month or year.
_YMD = r"(\d{4})-(\d{2})-(\d{2})"
_DMY = r"(\d{2})([/-])(\d{2})\2(\d{4})"


def _whole(pattern: str) -> str:
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    return rf"{flag}\A(?:{pattern.removeprefix('(?i)')})\z"


def _canonical(text: Column) -> Column:
    chain = None
    for kind, pattern, fields in _SHAPES:
        hit = text.rlike(_whole(pattern))
        out = F.regexp_replace(text, _whole(pattern), f"{kind};{fields}")
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    return chain


def _number(part: Column) -> Column:
    """The number in a captured group of digits; null for an absent group.

    A plain cast behind a test: a failed `try_cast` costs an exception per row.
    """
    return F.when(part != "", part.cast("int"))


def _month_number(part: Column) -> Column:
    name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(part, 1, 3)))
    return F.when(part.rlike(r"\A\d+\z"), part.cast("int")).when(name > 0, name.cast("int"))


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may overflow, e.g. month 13 or day 31 of February."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def _local_to_utc(at: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), at)


def _instant(p: Column, tz: str, day_first: bool) -> Column:
    kind, raw_year = p[0], _number(p[1])
    month, day = F.coalesce(_month_number(p[2]), F.lit(1)), F.coalesce(_number(p[3]), F.lit(1))
    if day_first:
        swap = kind == "numeric"
        month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
    # Two-digit years outside ISO forms: 00-49 are 20xx, 50-99 are 19xx.
    year = (F.when((kind == "iso") | (raw_year > 99), raw_year)
            .otherwise(raw_year + F.when(raw_year < 50, 2000).otherwise(1900)))

    hour, minute, second = (F.coalesce(_number(p[i]), F.lit(0)) for i in (4, 5, 6))
    milli = F.coalesce(_number(F.rpad(F.substring(p[7], 1, 3), 3, "0")), F.lit(0))
    half = F.lower(p[8])
    clock_ok = (F.when(half != "", hour.between(1, 12))
                .otherwise((hour <= 23) | ((hour == 24) & (minute == 0) & (second == 0) & (milli == 0))))
    hour24 = (F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour))
    valid = month.between(1, 12) & day.between(1, 31) & clock_ok & (minute <= 59) & (second <= 59)

    since_midnight = ((hour24 * 60 + minute) * 60 + second) * 1000 + milli
    local = F.when(valid, F.timestamp_add(
        "MILLISECOND", since_midnight, _rolled(year, month, day).cast("timestamp_ntz")))

    zone = F.lower(p[9])
    signed = zone.rlike(r"\A[+-]")
    off_h, off_m = (F.when(signed, F.substring(zone, start, 2).cast("int")) for start in (2, -2))
    minutes = (off_h * 60 + off_m) * F.when(zone.startswith("-"), 1).otherwise(-1)
    return let(local, lambda at: (
        F.when(zone == "", _local_to_utc(at, tz))
        .when(~signed, at)
        .when((off_h <= 23) & (off_m <= 59), F.timestamp_add("MINUTE", minutes, at))))


def parse_flexible_date(text: Column, tz: str = DEFAULT_ZONE, day_first: bool = False) -> Column:
    """Parse the date texts crawled records carry; null when no shape fits.

    A bare ISO date is UTC midnight, anything without an offset is local time in
    `tz`. `05/06/2026` is read month first unless `day_first`. Dates of the plain
    numeric shapes that have an impossible month or day are read day first and
    roll over into the next month or year.
    """
    def parse(text: Column) -> Column:
        return F.coalesce(
            let(F.split(_canonical(text), ";"), lambda p: _instant(p, tz, day_first)),
            _overflowing(text, _YMD, (1, 2, 3), tz),
            _overflowing(text, _DMY, (4, 3, 1), tz))

    return let(text, parse)


def _overflowing(text: Column, pattern: str, groups: tuple[int, int, int], tz: str) -> Column:
    """Local midnight of a plain numeric date whose month or day is out of range."""
    year, month, day = (_number(F.regexp_extract(text, _whole(pattern), g)) for g in groups)
    century = F.when(year < 100, 1900).otherwise(0)
    return F.when(text.rlike(_whole(pattern)),
                  _local_to_utc(_rolled(year + century, month, day).cast("timestamp_ntz"), tz))


def utc_day(at: Column) -> Column:
    """The UTC calendar day of an instant."""
    return at.cast("date")


def day_bounds(day: Column) -> tuple[Column, Column]:
    """Half-open bounds of a UTC day, for range predicates that reach the scan."""
    return day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz")


def iso_utc(at: Column) -> Column:
    """ISO-8601 text with milliseconds and a `Z`."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def in_zone(at: Column, tz: str = DEFAULT_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), at)


def month_key(at: Column, tz: str = DEFAULT_ZONE) -> Column:
    """`yyyy-MM` in the display zone."""
    return F.date_format(in_zone(at, tz), "yyyy-MM")


def month_label(key: Column) -> Column:
    """Full English month name of a `yyyy-MM` key."""
    return F.date_format(F.concat(key, F.lit("-01")).cast("date"), "MMMM")


def ordinal(day: Column) -> Column:
    """`1st`, `2nd`, `3rd`, `4th`, `11th` ..."""
    last = day % 10
    suffix = (F.when((last == 1) & (day != 11), "st")
              .when((last == 2) & (day != 12), "nd")
              .when((last == 3) & (day != 13), "rd")
              .otherwise("th"))
    return F.concat(day.cast("string"), suffix)


def day_label(at: Column, tz: str = DEFAULT_ZONE) -> Column:
    """Short weekday and ordinal day in the display zone."""
    local = in_zone(at, tz)
    return F.struct(F.date_format(local, "EEE").alias("weekday"),
                    ordinal(F.dayofmonth(local)).alias("day"))


def date_range_label(day: Column, days: int = 30) -> Column:
    """`May 2026`, or `May-June 2026` when the next `days` days end in another month.

    Only month numbers are compared, so a year's distance still reads as one month.
    """
    end = F.date_add(day, days)
    closing = F.date_format(end, "MMMM yyyy")
    return (F.when(F.month(day) == F.month(end), F.date_format(day, "MMMM yyyy"))
            .otherwise(F.concat(F.date_format(day, "MMMM"), F.lit("-"), closing)))


def is_future(at: Column, as_of: str) -> Column:
    """True from the start of the UTC day `as_of` on; a bare range predicate."""
    return at >= F.lit(as_of).cast("date").cast("timestamp_ntz")
