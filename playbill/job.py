"""Command line for spark-submit.

    job.py sync        --hits H --pages P --store S --as-of 2026-01-01 [--clear]
    job.py incremental --responses R --store S --checkpoint C
    job.py listing     --store S --as-of 2026-01-01 --out O
    job.py frontier    --pages P --out O
    job.py clear       --store S

Hits are JSON responses, pages Parquet rows (url, html), responses JSON rows
(batch, response).
"""

from __future__ import annotations

import argparse

from playbill.functions.dates import DEFAULT_ZONE
from playbill.operators.listing import LISTING_LIMIT, upcoming_listing
from playbill.plans.sync import SyncOptions, clear_store, crawl_frontier, sync_store
from playbill.session import build_session
from playbill.sources.responses import read_search_hits
from playbill.sources.store import Store
from playbill.streaming.incremental import start_incremental


def _limit(text: str) -> int | None:
    return None if text == "all" else int(text)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["sync", "incremental", "listing", "frontier", "clear"])
    for name in ("hits", "pages", "responses", "store", "checkpoint", "out", "as-of"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--tz", default=DEFAULT_ZONE)
    parser.add_argument("--clear", action="store_true")
    parser.add_argument("--seed", default="0")
    for name in ("hits-per-query", "max-sources", "links-per-page", "max-details"):
        parser.add_argument(f"--{name}", type=_limit, default=None, help="a number, or `all` (default)")
    parser.add_argument("--limit", type=int, default=LISTING_LIMIT)
    args = parser.parse_args(argv)

    spark = build_session(f"playbill-{args.command}")
    if args.command == "sync":
        options = SyncOptions(as_of=args.as_of, tz=args.tz, seed=args.seed,
                              hits_per_query=args.hits_per_query, max_sources=args.max_sources,
                              links_per_page=args.links_per_page, max_details=args.max_details)
        _, result = sync_store(Store(spark, args.store), read_search_hits(spark, args.hits),
                               spark.read.parquet(args.pages), options, clear=args.clear)
        print(result.stats.first().asDict())
    elif args.command == "incremental":
        start_incremental(spark, args.responses, args.store, args.checkpoint, tz=args.tz).awaitTermination()
    elif args.command == "clear":
        _, deleted = clear_store(Store(spark, args.store))
        print(deleted.first().asDict())
    elif args.command == "listing":
        store = Store(spark, args.store)
        upcoming_listing(store.gigs(), store.venues(), args.as_of, args.tz, args.limit).write.mode(
            "overwrite").parquet(args.out)
    else:
        crawl_frontier(spark.read.parquet(args.pages), args.max_details, args.seed, links_per_page=args.links_per_page).write.mode(
            "overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
