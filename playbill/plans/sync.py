"""The full run: search hits in, new gigs and venues out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.functions.base import compute_once
from playbill.functions.dates import DEFAULT_ZONE
from playbill.functions.html import choose_content, prompt_content
from playbill.functions.rules import EXTRACTION_GENRES, OTHER_CITIES, SKIP_GENRES, is_event_link
from playbill.operators.extraction import (
    BATCH_SIZE,
    POSITION_BITS,
    apply_rules,
    batch_counts,
    candidates,
    chunk,
    collect_batches,
    extract_events,
    extraction_index,
    normalize_gigs,
    score_batches,
    valid_dates,
)
from playbill.operators.frontier import (
    SITE_TIERS,
    add_if_absent,
    cap_hits,
    detail_targets,
    distinct_urls,
    project_hits,
    rank_sources,
    route_pages,
    sample_urls,
    unique_hits,
    with_links,
)
from playbill.operators.keyed import hash_range
from playbill.operators.reconcile import (
    Reconciled,
    Stage,
    clear_non_manual,
    reconcile,
    same,
    sync_stats,
)
from playbill.session import materialize
from playbill.sources.pages import has_text, scrape_rows, successful
from playbill.sources.seed import EXTRA_URLS
from playbill.sources.store import Head, Store


@dataclass(frozen=True)
class SyncOptions:
    as_of: str                                # UTC day; earlier events are dropped by rule
    tz: str = DEFAULT_ZONE
    day_first: bool = False
    # None, here and below, takes everything: hits, source pages that pass, links, detail pages.
    hits_per_query: int | None = None
    max_sources: int | None = None
    links_per_page: int | None = None
    max_details: int | None = None
    seed: str = "0"
    extra_urls: Sequence[str] = tuple(EXTRA_URLS)
    tiers: object = field(default_factory=lambda: SITE_TIERS)
    other_cities: Sequence[str] = OTHER_CITIES
    keep_genres: Sequence[str] = EXTRACTION_GENRES
    skip_genres: Sequence[str] = SKIP_GENRES
    link_rule: Callable[[Column], Column] = is_event_link
    batch_size: int = BATCH_SIZE
    budget: int | None = None                 # text units of a page that the rules or a model read


@dataclass
class SyncResult:
    hits: DataFrame
    sources: DataFrame
    details: DataFrame
    scored: DataFrame
    candidates: DataFrame
    reconciled: Reconciled
    stats: DataFrame
    batches: DataFrame   # successful and failed batches


def choose_sources(hits: DataFrame, o: SyncOptions, stage: Stage = same) -> tuple[DataFrame, DataFrame]:
    """Unique hits, and the source pages to read. No hits means no sources at all,
    not even the constant ones."""
    unique = unique_hits(cap_hits(project_hits(hits), o.hits_per_query))
    ranked = rank_sources(unique, o.tiers, o.max_sources, o.other_cities, stage)
    some = unique.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    return unique, add_if_absent(ranked, o.extra_urls).where(some)


def crawl_frontier(pages: DataFrame, n: int | None = None, seed: str = "0",
                   rule: Callable[[Column], Column] = is_event_link,
                   links_per_page: int | None = None) -> DataFrame:
    """Detail addresses found on pages (url, html): each once, then sampled."""
    linked = with_links(pages.select("url", "html"))
    return sample_urls(distinct_urls(route_pages(linked, rule, links_per_page)), n, seed)


def page_facts(pages: DataFrame, o: SyncOptions, texts: bool = True) -> DataFrame:
    """What a run needs of each page (url, html, or a row of `read_pages`): the addresses it leads to, whether it has content, and
    its content or, without `texts`, the events that the rules find in it. One pass over the markup; neither
    that nor, without `texts`, any page text goes further than this. Of several rows for one address the one with
    the longest content counts, then one by a digest of it."""
    budget = o.budget
    scraped = pages if "raw_html" in pages.columns else scrape_rows(pages.select("url", "html"))
    rows = successful(scraped)
    text, raw = F.col("text"), F.col("raw_html")
    content = F.when(has_text(), choose_content(text, raw) if budget is None else prompt_content(text, raw, budget))
    read = compute_once(rows.select("url", "text", "raw_html", "links"), content=content)
    body = F.col("content") if texts else extract_events(F.col("url"), F.col("content"))
    facts = compute_once(read.select("url", "links", "content"), targets=detail_targets(o.link_rule, o.links_per_page), body=body,
                         size=F.length("content"), digest=F.xxhash64("content")).drop("content", "links")
    best = F.max_by(F.struct("targets", "body", (F.col("size") > 0).alias("full")), F.struct("size", "digest", F.xxhash64("targets")))
    return facts.groupBy("url").agg(best.alias("f")).select("url", "f.targets", F.col("f.body").alias("content" if texts else "events"), "f.full")


def rule_records(numbered: DataFrame, o: SyncOptions) -> DataFrame:
    """Typed records of pages (batch, slot, events) with their extraction index: what a scorer's responses
    would give, without writing and reading them."""
    most = (1 << POSITION_BITS) // max(o.batch_size, 1)
    items = numbered.select("batch", "slot", F.posexplode("events").alias("at", "e"))
    pos = F.when(F.col("at") < most, F.col("slot") * most + F.col("at"))
    records = items.select("batch", pos.alias("pos"), "e.*", F.lit(None).cast("string").alias("image_url"))
    gigs = valid_dates(normalize_gigs(records, o.tz, o.day_first))
    return gigs.withColumn("i", extraction_index(F.col("batch"), F.col("pos")))


def rule_responses(placed: DataFrame) -> DataFrame:
    """What the rules found, as response texts (batch, response, error); no step of a run reads them."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("slot", "events"))), lambda p: p["events"])
    return placed.groupBy("batch").agg(F.to_json(F.struct(F.flatten(texts).alias("gigs"))).alias("response"),
                                       F.lit(None).cast("string").alias("error"))


def run_sync(
    hits: DataFrame,
    pages: DataFrame,
    gigs: DataFrame,
    venues: DataFrame,
    options: SyncOptions,
    fn: Callable[[str], str] | None = None,
    stage: Stage = materialize,
) -> SyncResult:
    """One run over tables: hits (query_idx, rank, url, title, description), raw
    pages (url, html) or scraped ones (`read_pages`), and the stored gigs and venues.

    `fn` answers batch prompts; without it the written rules extract the events.
    Steps whose result is used more than once go through `stage`.
    """
    o = options
    unique, sources = choose_sources(hits, o, stage)
    sources = stage(sources, "sources")
    # All pages are worked on once, where they lie; markup is never shuffled, nor is text for the rules.
    facts = stage(page_facts(pages, o, texts=fn is not None), "pages")

    targets = facts.join(sources, "url").select(F.explode("targets").alias("url")).distinct()
    frontier = stage(sample_urls(targets, o.max_details, o.seed), "frontier")
    details = stage(facts.join(frontier, "url").drop("targets"), "details")

    order = details.where("full").select("url", "sample_key")
    numbered = chunk(order, ["sample_key", "url"], hash_range(F.col("sample_key")), o.batch_size)
    placed = details.drop("sample_key").join(numbered, "url")
    if fn is None:
        scored = rule_responses(placed)
        found = apply_rules(rule_records(placed, o), o.as_of, o.keep_genres, o.skip_genres, o.other_cities)
    else:
        scored = stage(score_batches(collect_batches(placed), fn), "scored")
        found = candidates(scored, o.tz, o.day_first)
    found = stage(found, "candidates")

    result = reconcile(found, gigs, venues, stage)
    stats = sync_stats(unique, sources, details, result.outcomes)
    return SyncResult(unique, sources, details, scored, found, result, stats, batch_counts(scored))


def clear_store(store: Store) -> tuple[Head, DataFrame]:
    """Removes all gigs but manual ones; the count of removed ones is one row (`deleted`)."""
    head = store.head()
    gigs = store.gigs(head)
    kept, deleted = clear_non_manual(gigs)
    return store.replace(kept.drop("month"), gigs.limit(0).drop("month"), store.venues(head).limit(0), base=head), deleted


def sync_store(
    store: Store,
    hits: DataFrame,
    pages: DataFrame,
    options: SyncOptions,
    fn: Callable[[str], str] | None = None,
    clear: bool = False,
) -> tuple[Head, SyncResult]:
    """One run against a store. With `clear`, only manual gigs survive; the new state
    is complete before readers see it. Other runs may write meanwhile."""
    base = store.head()
    gigs, venues = store.gigs(base), store.venues(base)
    if clear:
        gigs, _ = clear_non_manual(gigs)
    result = run_sync(hits, pages, gigs, venues, options, fn)
    new = result.reconciled
    if clear:
        head = store.replace(gigs.drop("month"), new.gigs, new.venues, base=base)
    else:
        head = store.append(new.gigs, new.venues, base=base)
    return head, result
