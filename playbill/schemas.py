"""Row shapes of every table the jobs exchange.

Instants are TIMESTAMP_NTZ holding UTC wall-clock time, so no result depends on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

SEARCH_HIT = T.StructType([
    T.StructField("query_idx", T.IntegerType(), False),
    T.StructField("rank", T.IntegerType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
])

SEARCH_QUERY = T.StructType([
    T.StructField("query_idx", T.IntegerType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("country", T.StringType()),
    T.StructField("search_lang", T.StringType()),
    T.StructField("extra_snippets", T.BooleanType()),
])

SEARCH_RESPONSE = T.StructType([
    T.StructField("web", T.StructType([
        T.StructField("results", T.ArrayType(T.StructType([
            T.StructField("url", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("description", T.StringType()),
        ]))),
    ])),
])

SCRAPED_PAGE = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("raw_html", T.StringType()),
    T.StructField("success", T.BooleanType(), False),
    T.StructField("error", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
])

MODEL_GIG = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("title", "date", "venue_name", "description", "price",
                 "ticket_url", "url", "image_url")
])
MODEL_RESPONSE = T.StructType([T.StructField("gigs", T.ArrayType(MODEL_GIG))])

GIG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("date", T.TimestampNTZType(), False),
    T.StructField("time_display", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("venue_id", T.LongType()),
    T.StructField("manual", T.BooleanType()),
])

VENUE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("address", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("neighborhood", T.StringType()),
])

SYNC_STATS = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("search_results", "filtered_urls", "scraped_urls", "gigs_extracted",
                 "gigs_created", "gigs_skipped", "errors")
])

# Column limits of the stored tables (fixed values).
GIG_LIMITS = {"title": 255, "time_display": 20, "price": 50, "url": 500}
VENUE_LIMITS = {"name": 255, "website": 500, "neighborhood": 100}
