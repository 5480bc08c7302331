"""From search hits to the list of pages worth reading."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.base import let
from playbill.functions.html import hostname, page_links
from playbill.functions.rules import (
    OTHER_CITIES,
    SKIP_GENRES,
    SOCIAL_HOSTS,
    any_word,
    city_ok,
    is_event_link,
)
from playbill.operators.keyed import first_by, lookup_join, number_sorted, small, top_per
from playbill.session import materialize

# Source tiers by site: lower is better (fixed values). Unlisted sites rank 4.
SITE_TIERS = {
    "viva.gr": 1, "more.com": 1, "ticketservices.gr": 1, "athensvoice.gr": 1, "lifo.gr": 1, "rocking.gr": 1,
    "bandsintown.com": 5, "songkick.com": 5,
}
UNLISTED_TIER = 4
LAST_RESORT_TIER = 5
RESALE_SITES = ("viagogo.com", "stubhub.com")
# Up to so many rows are cut by Spark's own top-n, which keeps that many rows of each task and host.
DIRECT = 1000
# Hex digits of a sample key that one pass counts: 65,536 counts at most reach the driver.
DIGITS = 4


def project_hits(hits: DataFrame) -> DataFrame:
    """Only the fields of a hit that later steps read, and its position."""
    return hits.select("query_idx", "rank", "url", "title", "description")


def merge_hits(*hits: DataFrame) -> DataFrame:
    """Hits of several queries as one table; order lives in query_idx and rank."""
    return reduce(lambda a, b: a.unionByName(b), hits)


def cap_hits(hits: DataFrame, n: int | None = None) -> DataFrame:
    """At most `n` hits of each query, the best ranked ones; None keeps all."""
    return hits if n is None else top_per(hits, ["query_idx"], ["rank"], n)


def unique_hits(hits: DataFrame) -> DataFrame:
    """One hit per address: the first one seen keeps its title and description."""
    return first_by(hits, ["url"], ["query_idx", "rank"])


def distinct_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.select(F.col(column).alias("url")).distinct()


def site(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1)


def rank_sources(
    hits: DataFrame,
    tiers: Mapping[str, int] | DataFrame = SITE_TIERS,
    n: int | None = None,
    other_cities: Sequence[str] = OTHER_CITIES,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """The best `n` source pages, from as many different hosts as possible.

    Social, resale and past-event pages, other cities and skipped genres are out.
    Every host offers its best page before any host offers a second one; within a
    round lower tiers come first, and last-resort sites come after all others.
    `n=None` keeps and ranks every page that passes. `tiers` maps a host or site to its
    tier, as a mapping or, when the list is long, a table (host, tier); the host's own
    tier comes before its site's, and the better of two rows for one name counts. A table too long
    to be broadcast is looked up once per host; `stage` may write what that reads more than once.
    Above `DIRECT` pages, rounds are numbered in sampled ranges, so that no task holds a whole host.
    """
    words = F.concat_ws(" ", "title", "description")
    host = hostname(F.col("url"))
    kept = (
        hits.withColumn("host", host)
        .withColumn("site", site(F.col("host")))
        .where(
            ~F.col("site").isin(*SOCIAL_HOSTS, *RESALE_SITES)
            & ~words.rlike(r"(?i)\bpast (events|shows|concerts)\b")
            & city_ok(words, other_cities)
            & ~F.lower(words).rlike(any_word(SKIP_GENRES))
        )
    )
    if isinstance(tiers, DataFrame):
        known = _tiered(kept, tiers.groupBy("host").agg(F.min("tier").alias("_tier")), stage or (lambda df, name: df))
    else:
        table = F.create_map(*[F.lit(x) for pair in tiers.items() for x in pair])
        known = kept.withColumn("_tier", F.coalesce(table[F.col("host")], table[F.col("site")]))
    ranked = known.withColumn("tier", F.coalesce("_tier", F.lit(UNLISTED_TIER)).cast("int")).drop("_tier")
    if n is None:
        return ranked
    order = ["tier", "query_idx", "rank", "url"]
    if n > DIRECT:
        return _best_of_many(ranked, order, n, stage or materialize)
    return (
        top_per(ranked, ["host"], order, n, number="round")
        .orderBy((F.col("tier") >= LAST_RESORT_TIER).cast("int"), "round", *order)
        .limit(n)
    )


def _best_of_many(ranked: DataFrame, order: Sequence[str], n: int, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The first `n` pages when hosts take turns. All pages are numbered host by host; a page's round
    is its number less that of its host's first page. Those that can be chosen are numbered again by rounds."""
    numbered = stage(number_sorted(ranked, ["host", *order], "_no", stage), "numbered")
    hosts = numbered.groupBy("host").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("n"))
    turns = (lookup_join(numbered, hosts.drop("n"), ["host"], F.col("_no"), hosts.select("host", "n"))
             .withColumn("round", (F.col("_no") - F.col("_first") + 1).cast("int")).where(F.col("round") <= n)
             .withColumn("_late", (F.col("tier") >= LAST_RESORT_TIER).cast("int")).drop("_no", "_first"))
    places = number_sorted(turns, ["_late", "round", *order], "_place", stage)
    return places.where(F.col("_place") <= n).orderBy("_place").drop("_late", "_place")


def _tiered(kept: DataFrame, table: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`kept` with `_tier`: that of its host in `table` (host, _tier), or else that of its site."""
    own = table.select("host", F.col("_tier").alias("_own"))
    by_site = table.select(F.col("host").alias("site"), F.col("_tier").alias("_site_tier"))
    if small(table):
        both = kept.join(F.broadcast(own), "host", "left").join(F.broadcast(by_site), "site", "left")
        return both.withColumn("_tier", F.coalesce("_own", "_site_tier")).drop("_own", "_site_tier")
    kept = stage(kept, "kept")
    hosts = stage(kept.groupBy("host").agg(F.first("site").alias("site"), F.count(F.lit(1)).alias("n")), "hosts")
    # Hosts are unique, sites are not: those lookups may meet a hot key.
    sites = lookup_join(hosts.join(own, "host", "left"), by_site, ["site"], F.col("host"), fits=False)
    tier = stage(sites.select("host", F.coalesce("_own", "_site_tier").alias("_tier")).where("_tier IS NOT NULL"), "tiers")
    return lookup_join(kept, tier, ["host"], F.concat_ws(":", "query_idx", "rank", "url"), hosts.select("host", "n"))


def add_if_absent(urls: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Append constant addresses that the table does not hold yet.

    Only the constants found in the table are looked at, so the lookup side never
    has more rows than `extra`.
    """
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(u,) for u in dict.fromkeys(extra)], "url string")
    found = urls.select("url").where(F.col("url").isin(*extra)).distinct()
    return urls.select("url").unionByName(wanted.join(F.broadcast(found), "url", "left_anti"))


def event_links(links: Column, rule: Callable[[Column], Column] = is_event_link,
                n: int | None = None) -> Column:
    """The links of one page that lead to single events; with `n`, its first n."""
    chosen = F.filter(links, lambda link: rule(link))
    return chosen if n is None else F.slice(chosen, 1, n)


def detail_targets(rule: Callable[[Column], Column] = is_event_link,
                   n: int | None = None) -> Column:
    """Detail addresses of a page (url, links): the chosen links, or the page itself
    when it has no links at all."""
    def choose(links: Column) -> Column:
        return F.when(F.size(links) > 0, event_links(links, rule, n)).otherwise(F.array("url"))

    return let(F.coalesce("links", F.array().cast("array<string>")), choose)


def route_pages(pages: DataFrame, rule: Callable[[Column], Column] = is_event_link,
                n: int | None = None) -> DataFrame:
    """The detail addresses that pages (url, links) lead to."""
    return pages.select(F.explode(detail_targets(rule, n)).alias("url"))


def sample_key(url: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), url))


def sample_urls(urls: DataFrame, n: int | None = None, seed: str = "0",
                stage: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """A reproducible random sample of `n` addresses, spread over all sources; None keeps all.

    They are the first ones by a seeded hash, which does not depend on partitioning. Above `DIRECT`
    rows the cut is found from counts of hash prefixes, so the sample stays spread over the cluster.
    """
    keyed = urls.select("url", sample_key(F.col("url"), seed).alias("sample_key"))
    if n is None:
        return keyed
    if n <= DIRECT:
        return keyed.orderBy("sample_key", "url").limit(n)
    keyed = stage(keyed, "sample_keys")
    taken, rest, left = keyed.limit(0), keyed, n
    for digit in range(1, 32, DIGITS):
        prefix = F.substring("sample_key", digit, DIGITS)
        counts = sorted((r.p, r.n) for r in rest.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        whole, cut = 0, None
        for p, rows in counts:
            if whole + rows > left:
                cut = p
                break
            whole += rows
        if cut is None:  # all that is left fits
            return taken.unionByName(rest)
        taken, rest, left = taken.unionByName(rest.where(prefix < cut)), rest.where(prefix == cut), left - whole
        if left <= DIRECT:
            break
    # Beyond the last digit only copies of one address are left.
    return taken.unionByName(rest.orderBy("sample_key", "url").limit(left))


def with_links(pages: DataFrame) -> DataFrame:
    """Pages (url, html) with their same-host links."""
    return pages.withColumn("links", page_links(F.col("html"), F.col("url")))
