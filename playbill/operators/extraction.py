"""From page content to clean event records: batches, scoring, parsing, rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.base import WS, compute_once, let, present, trim_text
from playbill.functions.dates import DEFAULT_ZONE, is_future, parse_flexible_date, utc_day
from playbill.functions.rules import EXTRACTION_GENRES, OTHER_CITIES, SKIP_GENRES, city_ok, genre_ok
from playbill.functions.text import clean_title, gig_url, name_key, normalize_price, venue_or_default
from playbill.operators.keyed import first_by, number_rows, number_sorted
from playbill.session import materialize
from playbill.sources.responses import parse_gig_responses

BATCH_SIZE = 2
# Record order inside a run: batch number in the high bits, position in the low ones.
POSITION_BITS = 24

TICKET_SITES = ("more.com", "viva.gr", "ticketmaster")


# --- batches ---------------------------------------------------------------

def chunk(pages: DataFrame, order: Sequence[str], bucket: Column | None = None, size: int = BATCH_SIZE,
          stage: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Cut an ordered table into batches of `size` rows: batch number and slot.

    `bucket` is as for `number_rows`, for keys that are known to be dense or hashes; without it the
    rows are written in sampled ranges, so their keys may be as sparse as they like. Batches run across the borders.
    """
    numbered = number_sorted(pages, order, "_row", stage) if bucket is None else number_rows(pages, order, bucket, "_row")
    return (numbered.withColumn("batch", F.floor((F.col("_row") - 1) / size).cast("bigint"))
            .withColumn("slot", F.pmod(F.col("_row") - 1, F.lit(size)).cast("int"))
            .drop("_row"))


def collect_batches(chunks: DataFrame) -> DataFrame:
    """One row per batch with its pages in order; a group never exceeds the batch size."""
    page = F.struct("slot", "url", "content")
    return chunks.groupBy("batch").agg(F.sort_array(F.collect_list(page)).alias("pages"))


# --- prompts ---------------------------------------------------------------

_FIELDS = "title, date, venue_name, description, price, ticket_url, url, image_url"


def render_prompt(kind: str, **slots: Column) -> Column:
    """Prompt text for one of the four model steps.

    `sources` takes hits; `links` takes url, title and links; `page` takes url and
    content; `batch` takes pages (array of url, content).
    """
    if kind == "sources":
        return F.concat(F.lit(
            "Pick the 5 to 10 result pages most likely to list upcoming concerts in Athens.\n"
            'Answer with JSON: {"promising_urls": [...]}\n\nResults:\n\n'), slots["hits"])
    if kind == "links":
        numbered = F.array_join(
            F.transform(slots["links"], lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), u)), "\n")
        return F.concat(
            F.lit("Pick up to 20 links that lead to a single event.\n"
                  'Answer with JSON: {"event_detail_urls": [...]}\n\nPage: '), slots["url"],
            F.lit("\nTitle: "), F.coalesce(present(slots["title"]), F.lit("N/A")),
            F.lit("\nLinks ("), F.size(slots["links"]).cast("string"), F.lit("):\n"), numbered)
    intro = f'List the upcoming concerts in the text below as JSON: {{"gigs": [...]}} with {_FIELDS}.\n\n'
    if kind == "page":
        return F.concat(F.lit(intro + "Source: "), slots["url"], F.lit("\n\n"), slots["content"])
    if kind == "batch":
        blocks = F.transform(slots["pages"], lambda p, i: F.concat(
            F.lit("--- page "), (i + 1).cast("string"), F.lit(" ---\nSource: "), p["url"],
            F.lit("\n\n"), p["content"]))
        return F.concat(F.lit(intro), F.array_join(blocks, "\n\n"))
    raise ValueError(f"unknown prompt kind: {kind}")


# --- scoring ---------------------------------------------------------------

# Both shapes begin with two digits, which is all that most places of a text are looked at for.
_DATE = r"\d\d(?:\d\d-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?|/\d{2}/\d{4})"
_AMOUNT = r"\d+(?:[.,]\d+)?"
_PRICE = (rf"(?=[sSfF€\d])(?i:sold\s*out|free (?:entry|admission)|€\s*{_AMOUNT}(?:\s*-\s*€?\s*{_AMOUNT})?"
          rf"|{_AMOUNT}\s*(?:€(?!\d)|EUR))")
_TICKET = rf"\((https?://[^\s()]*(?:{'|'.join(s.replace('.', r'[.]') for s in TICKET_SITES)})[^\s()]*)\)"

# A block of a page's content ends behind a sentence, a closing bracket, a bar or a bullet, and behind a
# price that stands first in it. Short forms of names and words end no sentence.
_SHORT = r"(?<!\b(?:St|Mr|Ms|Dr|vs|ft|No|Mrs|feat)[.])"
_BLOCK_END = rf"[.!?;)|•·](?={WS}|\z){_SHORT}"
_FIRST_PRICE = rf"(?s)\A(?:{WS}|[-–,:])*{_PRICE}"
_EDGE = rf"(?:{WS}|[-–|•·,:])+"
_LINK = r"\(https?://[^\s()]*\)"
_BUY = r"(?i)\A(?:buy |book )?(?:tickets?|info|more)?\z"
_TIME = rf"\A\d{{1,2}}[:.]\d{{2}}(?:{WS}*(?:h|hrs|am|pm))?(?={WS})"
_VENUE_SIGN = rf"(?is)(?:@|{WS}at{WS})"
_TEXT, _AMOUNT_ONLY, _TICKETS, _BLANK = range(4)
# What a date's side must be ahead by to decide for itself, without the page.
_CLEAR = 2


# The same marks for plain trimming, which is many times faster than a pattern.
_EDGE_MARKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff-–|•·,:"
_STOPS = ".!?;"
# Longer texts are no price, however written.
_PRICE_LENGTH = 60


def _bare(text: Column) -> Column:
    """Text without the white space and marks around it."""
    return F.btrim(text, F.lit(_EDGE_MARKS))


def _blocks(gap: Column) -> Column:
    """What stands between two dates as blocks (raw, text, kind)."""
    def block(raw: Column) -> Column:
        linked = raw.contains("http")
        plain = F.when(linked, F.regexp_replace(raw, _LINK, " ")).otherwise(raw)
        text = F.ltrim(F.rtrim(plain, F.lit(_EDGE_MARKS + _STOPS)), F.lit(_EDGE_MARKS))
        return let(text, lambda t: F.struct(
            raw.alias("raw"), t.alias("text"),
            F.when((F.length(t) <= _PRICE_LENGTH) & t.rlike(rf"\A{_PRICE}\z"), _AMOUNT_ONLY)
            .when(linked & raw.rlike(_LINK) & t.rlike(_BUY), _TICKETS)
            .when(t.rlike(r"[\p{L}\p{N}]"), _TEXT).otherwise(_BLANK).alias("kind")))

    marked = F.regexp_replace(F.regexp_replace(gap, _FIRST_PRICE, "$0\u0001"), _BLOCK_END, "$0\u0001")
    return F.transform(F.split(marked, "\u0001", -1), block)


def _raw(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["raw"]), "")


def _gap(text: Column, first: Column, last: Column, unread: Column) -> Column:
    """One gap between dates. For a date behind it (trailing dates): `head`, the blocks that may
    name its event, and `rest`, what stays with the date before. For a date in front of it (leading
    dates): its blocks. With each the score of that reading: is there a text, does it name a venue, does it stand
    right beside the date."""
    def sectioned(blocks: Column) -> Column:
        n = F.size(blocks)
        places = F.sequence(F.lit(0), n - 1)

        def hard(i: Column) -> Column:
            b = F.get(blocks, i)
            return b["kind"].isin(_AMOUNT_ONLY, _TICKETS) | ((i < n - 1) & F.right(F.rtrim(b["raw"]), F.lit(1)).isin(*_STOPS, ")"))

        def filled(i: Column) -> Column:
            return F.get(blocks, i)["kind"] == _TEXT

        # Where the section of the next date starts: behind the last hard end that has text behind it,
        # else at the last text; on the way to the first date, at the first one.
        def start(last_text: Column) -> Column:
            cut = F.coalesce(F.array_max(F.filter(places, lambda i: (i < last_text) & hard(i))), F.lit(-1))
            return F.when(last | last_text.isNull(), n).otherwise(let(cut, lambda c: F.when(first | (c >= 0), c + 1).otherwise(last_text)))

        return let(F.array_max(F.filter(places, filled)), lambda last_text: let(start(last_text), lambda at: scored(blocks, at)))

    def scored(blocks: Column, at: Column) -> Column:
        n = F.size(blocks)
        texts = F.filter(blocks, lambda b: b["kind"] == _TEXT)
        head = F.filter(F.slice(blocks, at + 1, n), lambda b: b["kind"] == _TEXT)
        near, ahead = F.get(blocks, n - 1), F.get(blocks, F.lit(0))
        one = F.get(texts, F.lit(0))["text"]
        follows = F.coalesce(~one.rlike(rf"(?i)\A(?:@|at{WS})"), F.lit(False))

        def points(*signs: Column) -> Column:
            total = F.lit(0)
            for sign in signs:
                total = total + F.coalesce(sign.cast("int"), F.lit(0))
            return total

        return F.struct(
            text.alias("whole"), texts.alias("texts"), head.alias("head"), _raw(F.slice(blocks, F.lit(1), at)).alias("rest"),
            F.when(~last, points(F.size(head) > 0, F.exists(head, lambda b: b["text"].rlike(_VENUE_SIGN)), near["kind"] == _TEXT))
            .otherwise(0).alias("trail"),
            F.when(~first & follows, points(F.size(texts) > 0, one.rlike(_VENUE_SIGN), ahead["kind"] == _TEXT)).otherwise(0).alias("lead"))

    return let(_blocks(F.when(unread, "").otherwise(text)), sectioned)


def extract_events(url: Column, content: Column) -> Column:
    """The events a page announces, by rule: one for each date that a headline belongs to.

    The content is cut into blocks of date, price, ticket link and text. A date either trails its
    headline (`Band @ Hall 2026-02-15 €10`) or leads it (`2026-02-15 Band @ Hall €10`). Both readings are
    scored for every date: a side that is clearly ahead decides for its date, the sums of the page for
    the others, and a tie is read as trailing. Text that two dates could claim goes to the reading of the
    page. The venue is what follows `@` or `at` in the headline, else the block behind a bar after it. A
    page with one date that leads needs a venue, a price or a ticket link.
    """
    def gaps_of(text: Column, dates: Column) -> Column:
        return let(cut_at(text, dates), lambda pieces: read(pieces, dates))

    def cut_at(text: Column, dates: Column) -> Column:
        """What stands between the dates; one date alone is found again by its text, without the pattern."""
        one = F.get(dates, F.lit(0))
        head = F.call_function("substring_index", text, one, F.lit(1))
        return F.when(F.size(dates) == 1, F.array(head, F.substr(text, F.length(head) + F.length(one) + 1))).otherwise(F.split(text, _DATE, -1))

    def read(pieces: Column, dates: Column) -> Column:
        count = F.size(dates)
        # One date behind one plain headline with a venue: no reading of what follows can be ahead of that.
        head = F.get(pieces, F.lit(0))
        plain = (count == 1) & head.rlike(_VENUE_SIGN) & ~head.rlike(rf"[{_STOPS})|•·€]") & head.rlike(rf"[\p{{L}}\p{{N}}]{WS}*\z")
        gaps = let(plain, lambda clear: F.transform(pieces, lambda g, k: _gap(g, k == 0, k == count, clear & (k == 1))))
        return let(gaps, lambda gs: let(page(gs, count), lambda modes: events(gs, dates, count, modes)))

    def page(gaps: Column, count: Column) -> Column:
        """For each date, whether it leads; the page's own reading stands behind the last."""
        total = F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g["lead"] - g["trail"])

        def leads(k: Column, vote: Column) -> Column:
            ahead = F.get(gaps, k + 1)["lead"] - F.get(gaps, k)["trail"]
            return F.when(F.abs(ahead) >= _CLEAR, ahead > 0).otherwise(vote)

        return let(total > 0, lambda vote: F.concat(
            F.transform(F.sequence(F.lit(0), count - 1), lambda k: leads(k, vote)), F.array(vote)))

    def events(gaps: Column, dates: Column, count: Column, leads: Column) -> Column:
        def one(date: Column, k: Column) -> Column:
            return F.when(F.get(leads, k), leading(gaps, date, k, count, leads)).otherwise(trailing(gaps, date, k, count, leads))

        return F.filter(F.transform(dates, one), lambda e: e.isNotNull())

    def claimed(gaps: Column, k: Column, leads: Column) -> Column:
        """Whether gap k has one text only and the dates on both of its sides want it."""
        return (k > 0) & F.get(leads, k - 1) & ~F.get(leads, k) & (F.size(F.get(gaps, k)["texts"]) == 1)

    def rest_of(gaps: Column, k: Column, count: Column, leads: Column) -> Column:
        """What gap k leaves to the date in front of it."""
        gap = F.get(gaps, k)
        return F.when((k == count) | F.get(leads, k), gap["whole"]).otherwise(gap["rest"])

    def trailing(gaps: Column, date: Column, k: Column, count: Column, leads: Column) -> Column:
        gap = F.get(gaps, k)
        # A page with one date has one headline: all that stands before it.
        whole = F.when((count == 1) & ~gap["whole"].contains("|"), _bare(gap["whole"]))
        after = rest_of(gaps, k + 1, count, leads)
        lost = claimed(gaps, k, leads) & F.element_at(leads, -1)
        return let(F.struct(gap["head"].alias("head"), whole.alias("whole"), after.alias("after")),
                   lambda s: F.when(~lost, built(s["head"], s["whole"], date, s["after"])))

    def leading(gaps: Column, date: Column, k: Column, count: Column, leads: Column) -> Column:
        gap = F.get(gaps, k + 1)
        # With a trailing date behind, this event ends where the next one's headline starts.
        ends = (k + 1 < count) & ~F.get(leads, F.least(k + 1, count - 1)) & (F.size(gap["texts"]) > 1)
        mine = F.when(ends, gap["rest"]).otherwise(gap["whole"])
        lost = (k + 1 < count) & F.coalesce(claimed(gaps, k + 1, leads), F.lit(False)) & ~F.element_at(leads, -1)
        sure = (count > 1) | mine.rlike(_PRICE) | mine.rlike(_TICKET) | F.get(gap["texts"], F.lit(0))["text"].rlike(_VENUE_SIGN)
        return let(F.struct(gap["texts"].alias("texts"), mine.alias("mine")), lambda s: F.when(~lost & sure, built(
            s["texts"], F.lit(None).cast("string"), date, s["mine"], inside=True)))

    def built(head: Column, whole: Column, date: Column, after: Column, inside: bool = False) -> Column:
        """The event named by a list of text blocks: by the first that names a venue, or by the first. `inside`:
        the headline is part of `after`."""
        named = F.lit(None).cast("string") if inside else F.get(
            F.filter(head, lambda b: b["text"].rlike(_VENUE_SIGN)), F.lit(0))["text"]
        first, second = F.get(head, F.lit(0)), F.get(head, F.lit(1))
        barred = F.when(named.isNull() & first["raw"].rlike(rf"[|•·]{WS}*\z"), second["text"])
        title = F.coalesce(whole, named, first["text"])
        title = _bare(F.regexp_replace(_bare(F.regexp_replace(title, _TIME, "")), rf"{_PRICE}\z", ""))
        return let(F.struct(title.alias("title"), barred.alias("barred")), lambda t: F.when(
            t["title"] != "", event(t["title"], t["barred"], date, after, inside)))

    def event(title: Column, barred: Column, date: Column, after: Column, inside: bool) -> Column:
        venue = present(trim_text(F.regexp_extract(title, rf"(?is)(?:@|{WS}at{WS})(.*)\z", 1)))
        text = F.substr(after, F.instr(after, title) + F.length(title)) if inside else after
        said = after if inside else F.concat(title, F.lit(" | "), after)
        return F.struct(
            title.alias("title"),
            date.alias("date"),
            F.coalesce(venue, barred).alias("venue_name"),
            let(F.regexp_replace(trim_text(text), rf"\A{_EDGE}", "") if inside else trim_text(text), present).alias("description"),
            let(F.regexp_extract(said, _PRICE, 0), lambda p: F.when(p != "", p).otherwise("N/A")).alias("price"),
            let(F.regexp_extract(after, _TICKET, 1), present).alias("ticket_url"),
            url.alias("url"),
        )

    def dated(text: Column) -> Column:
        found = F.coalesce(F.regexp_extract_all(text, F.lit(f"({_DATE})"), F.lit(1)), F.array().cast("array<string>"))
        return let(found, lambda dates: F.when(F.size(dates) > 0, gaps_of(text, dates)).otherwise(none))

    none = F.array().cast("array<struct<title:string,date:string,venue_name:string,description:string,price:string,ticket_url:string,url:string>>")
    return let(content, dated)


def rule_response(pages: Column) -> Column:
    """The default scorer: a response text for one batch, made by rule."""
    events = F.flatten(F.transform(pages, lambda p: extract_events(p["url"], p["content"])))
    return F.to_json(F.struct(events.alias("gigs")))


def score_batches(batches: DataFrame, fn: Callable[[str], str] | None = None, attempts: int = 3) -> DataFrame:
    """Response text per batch (batch, response, error).

    Without `fn` the rules above answer, inside the JVM. With `fn`, a function from
    prompt text to response text, calls run on the executors; a call that fails is
    made up to `attempts` times in all, then its batch has an error and no response,
    and the others go on.
    """
    if fn is None:
        return batches.select("batch", rule_response(F.col("pages")).alias("response"),
                              F.lit(None).cast("string").alias("error"))

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            responses, errors = [], []
            for prompt in frame["prompt"]:
                response, failure = None, None
                for _ in range(max(attempts, 1)):
                    try:
                        response, failure = fn(prompt), None
                        break
                    except Exception as error:
                        failure = f"{type(error).__name__}: {error}"
                responses.append(response)
                errors.append(failure)
            yield pd.DataFrame({"batch": frame["batch"], "response": responses, "error": errors})

    prompts = batches.select("batch", render_prompt("batch", pages=F.col("pages")).alias("prompt"))
    return prompts.mapInPandas(answer, "batch bigint, response string, error string")


def batch_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count_if(F.col("error").isNull()).alias("successful"),
                      F.count_if(F.col("error").isNotNull()).alias("failed"))


# --- records ---------------------------------------------------------------

def normalize_gigs(records: DataFrame, tz: str = DEFAULT_ZONE, day_first: bool = False) -> DataFrame:
    """Typed records of a response: date, venue, price and link in their stored form.

    The date is null where it could not be read.
    """
    kept = [c for c in records.columns
            if c not in ("title", "date", "venue_name", "description", "price", "ticket_url", "url", "image_url")]
    dated = compute_once(records, date=parse_flexible_date(F.col("date"), tz, day_first))
    return dated.select(
        *kept, "title", "date",
        venue_or_default(F.col("venue_name")).alias("venue_name"),
        "description",
        normalize_price(F.col("price")).alias("price"),
        gig_url(F.col("ticket_url"), F.col("url")).alias("url"),
        "image_url",
    )


def valid_dates(gigs: DataFrame) -> DataFrame:
    return gigs.where(F.col("date").isNotNull())


def merge_gigs(*gigs: DataFrame) -> DataFrame:
    """Records of several batches as one table; a failed batch adds no rows."""
    return reduce(lambda a, b: a.unionByName(b), gigs)


def dedupe_in_batch(gigs: DataFrame) -> DataFrame:
    """One record per batch, title and UTC day: the first."""
    keyed = gigs.withColumn("_title", name_key(F.col("title"))).withColumn("_day", utc_day(F.col("date")))
    return first_by(keyed, ["batch", "_title", "_day"], ["pos"]).drop("_title", "_day")


def apply_rules(
    gigs: DataFrame,
    as_of: str,
    keep: Sequence[str] = EXTRACTION_GENRES,
    skip: Sequence[str] = SKIP_GENRES,
    other_cities: Sequence[str] = OTHER_CITIES,
) -> DataFrame:
    """The written extraction rules: genre, city, future dates, bare titles, no repeats."""
    about = F.concat_ws(" ", "title", "description")
    place = F.concat_ws(" ", "venue_name", "description")
    chosen = gigs.where(
        is_future(F.col("date"), as_of) & genre_ok(about, keep, skip) & city_ok(place, other_cities))
    return dedupe_in_batch(chosen.withColumn("title", clean_title(F.col("title"))))


def extraction_index(batch: Column, pos: Column) -> Column:
    """Order of a record inside a run, as one unique number; null for a batch number or
    position that does not fit, which makes the record an error and stops nothing."""
    fits = pos.between(0, (1 << POSITION_BITS) - 1) & batch.between(0, (1 << (62 - POSITION_BITS)) - 1)
    return F.when(fits, F.shiftleft(batch, POSITION_BITS).bitwiseOR(pos.cast("bigint")))


def candidates(scored: DataFrame, tz: str = DEFAULT_ZONE, day_first: bool = False) -> DataFrame:
    """Dated, typed records of all batches with their extraction index `i`."""
    parsed = parse_gig_responses(scored, "response", "batch")
    gigs = valid_dates(normalize_gigs(parsed, tz, day_first))
    return gigs.withColumn("i", extraction_index(F.col("batch"), F.col("pos")))
