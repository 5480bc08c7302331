"""The given tables read as the library's tables.

orders stand in for gigs and for event pages, customer for venues, pages for
crawled pages. Every derivation has an SQL twin (`*_SQL`, common table
expressions for DuckDB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns for work that is heavy per row: when the scan has fewer
    partitions than the cluster has cores, as with one small file, rows are spread
    over all of them. A scan of a large table is left as it is."""
    rows = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# --- gigs and venues -------------------------------------------------------

_PRICE_CASES = [
    "'€' || n", "n || '€'", "n || ',50'", "n || '.50 EUR'", "'€' || (n + 10) || '-€' || n", "'Sold  Out!'",
    "'FREE entry'", "'N/A'", "'€'", "'EUR'", "''", "'tba'", "'€0.40'", "n || '.000,50'", "' €' || n || ' '",
    "CAST(NULL AS VARCHAR(9))",
]
PRICE_CASE = "CASE k % 16 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_PRICE_CASES)) + " END"

_TITLE = """CASE WHEN {k} % 101 = 0 THEN NULL
     WHEN {k} % 97 = 0 THEN repeat('Act ' || ({c} % 50), 60)
     WHEN {k} % 3 = 0 THEN upper('Act ' || ({c} % 50))
     ELSE 'Act ' || ({c} % 50) END"""
_VENUE = """CASE WHEN {k} % 89 = 0 THEN repeat('Hall ', 60)
     WHEN {c} % 4 = 0 THEN 'CUSTOMER#' || lpad(CAST({c} AS VARCHAR(20)), 9, '0')
     WHEN {c} % 4 = 1 THEN ''
     WHEN {c} % 4 = 2 THEN 'Hall ' || ({c} % 300)
     ELSE 'HALL ' || ({c} % 300) END"""
_URL = "CASE WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 5 = 1 THEN '' ELSE 'https://x.gr/' || {k} END"


def _sql(template: str) -> str:
    return template.format(k="o_orderkey", c="o_custkey")


def gigs(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """Stored gigs: one per order, at a time of day that depends on its key."""
    return table(spark, sf_dir, "orders").where(which).selectExpr(
        "o_orderkey AS id",
        f"coalesce({_sql(_TITLE)}, 'Untitled') AS title",
        "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST(o_orderkey % 60 AS INT)) AS date",
        "CAST(NULL AS STRING) AS time_display",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Free' ELSE '€' || (o_orderkey % 40) END AS price",
        "o_orderpriority AS description",
        f"{_sql(_URL)} AS url",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS venue_id",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS manual",
    )


GIGS_SQL = f"""gigs AS (
  SELECT o_orderkey AS id, coalesce({_sql(_TITLE)}, 'Untitled') AS title,
    o_orderdate + to_minutes((o_orderkey % 24) * 60 + o_orderkey % 60) AS date,
    CAST(NULL AS VARCHAR) AS time_display,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Free' ELSE '€' || (o_orderkey % 40) END AS price,
    o_orderpriority AS description, {_sql(_URL)} AS url,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS venue_id,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS manual
  FROM orders)"""

_VENUE_COLUMNS = """c_custkey AS id, c_name AS name, 'Street ' || c_nationkey AS address,
    CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE 'https://v' || c_custkey || '.gr' END AS website,
    c_mktsegment AS neighborhood"""


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_columns(_VENUE_COLUMNS))


VENUES_SQL = f"venues AS (SELECT {_VENUE_COLUMNS} FROM customer)"


def _columns(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, start = [], 0, 0
    quoted = False
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(text[start:i].strip())
                start = i + 1
    return [*out, text[start:].strip()]


# --- new records against stored ones --------------------------------------

def stored_gigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders, as gigs that are already stored."""
    return gigs(spark, sf_dir, "o_orderstatus = 'F'")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders still open, as extracted records in order `i`."""
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").selectExpr(
        "o_orderkey AS i", f"{_sql(_TITLE)} AS title",
        "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), CAST(o_orderkey % 60 AS INT)) AS date",
        f"coalesce(nullif({_sql(_VENUE)}, ''), 'Unknown Venue') AS venue_name",
        "o_orderpriority AS description", "'€' || (o_orderkey % 40) AS price",
        "'https://x.gr/' || o_orderkey AS url")


RECORDS_SQL = f"""{GIGS_SQL}, {VENUES_SQL},
stored AS (SELECT g.* FROM gigs g JOIN orders o ON g.id = o.o_orderkey WHERE o.o_orderstatus = 'F'),
records AS (
  SELECT o_orderkey AS i, {_sql(_TITLE)} AS title,
    o_orderdate + to_minutes((o_orderkey % 24) * 60 + o_orderkey % 60) AS date,
    coalesce(nullif({_sql(_VENUE)}, ''), 'Unknown Venue') AS venue_name,
    o_orderpriority AS description, '€' || (o_orderkey % 40) AS price, 'https://x.gr/' || o_orderkey AS url
  FROM orders WHERE o_orderstatus <> 'F')"""

# Outcome of each record; needs `records`, `stored` and `venues`.
OUTCOMES_SQL = """keyed AS (
  SELECT *, replace(lower(title), 'ς', 'σ') AS tk, CAST(date AS DATE) AS dk,
    CASE WHEN title IS NULL OR title = '' THEN 'title_missing' WHEN length(title) > 255 THEN 'title_too_long'
         WHEN length(price) > 50 THEN 'price_too_long' WHEN length(url) > 500 THEN 'url_too_long'
         WHEN length(venue_name) > 255 THEN 'venue_too_long' END AS reason
  FROM records),
ranked AS (SELECT *, min(CASE WHEN reason IS NULL THEN i END) OVER (PARTITION BY tk, dk) AS fv FROM keyed),
outcomes AS (
  SELECT r.*, CASE
      WHEN EXISTS (SELECT 1 FROM stored s WHERE replace(lower(s.title), 'ς', 'σ') = r.tk AND CAST(s.date AS DATE) = r.dk)
        THEN 'skipped'
      WHEN i > fv THEN 'skipped' WHEN i = fv THEN 'created' ELSE 'error' END AS outcome
  FROM ranked r),
named AS (
  SELECT replace(lower(venue_name), 'ς', 'σ') AS vk, min(i) AS first_i, arg_min(venue_name, i) AS name
  FROM outcomes WHERE outcome <> 'skipped' AND length(venue_name) <= 255 GROUP BY 1),
known AS (SELECT replace(lower(name), 'ς', 'σ') AS vk, min(id) AS stored_id FROM venues GROUP BY 1),
new_venues AS (
  SELECT n.vk, n.name, (SELECT coalesce(max(id), 0) FROM venues) + row_number() OVER (ORDER BY n.first_i) AS id
  FROM named n WHERE n.vk NOT IN (SELECT vk FROM known)),
new_gigs AS (
  SELECT (SELECT coalesce(max(id), 0) FROM stored) + row_number() OVER (ORDER BY o.i) AS id, o.title, o.date, o.price,
    o.description, o.url, coalesce(k.stored_id, v.id) AS venue_id
  FROM outcomes o LEFT JOIN known k ON k.vk = replace(lower(o.venue_name), 'ς', 'σ')
    LEFT JOIN new_venues v ON v.vk = replace(lower(o.venue_name), 'ς', 'σ')
  WHERE o.outcome = 'created')"""


# --- response texts --------------------------------------------------------

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response text per order, as a scorer would send it; some are not JSON,
    some have no list, some hold a record without a date."""
    good = F.expr(f"""to_json(named_struct('gigs', array(
        named_struct('title', {_sql(_TITLE)},
                     'date', date_format(o_orderdate, 'yyyy-MM-dd') || 'T2' || (o_orderkey % 4) || ':30:00Z',
                     'venue_name', {_sql(_VENUE)}, 'price', '€' || (o_orderkey % 40),
                     'ticket_url', CASE WHEN o_orderkey % 2 = 0 THEN 'www.t.gr/' || o_orderkey END,
                     'url', 'https://x.gr/' || o_orderkey),
        named_struct('title', 'Late show', 'date', 'soon', 'venue_name', 'Hall', 'price', 'N/A',
                     'ticket_url', CAST(NULL AS STRING), 'url', ''))))""")
    text = (F.when(F.expr("o_orderkey % 17 = 0"), "not json")
            .when(F.expr("o_orderkey % 19 = 0"), "{}")
            .when(F.expr("o_orderkey % 23 = 0"), '{"gigs":[]}')
            .otherwise(good))
    orders = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return orders.select(F.col("o_orderkey").alias("batch"), text.alias("response"))


# What reading those texts must give; needs `orders`.
PARSED_SQL = f"""parsed AS (
  SELECT o_orderkey AS batch, {_sql(_TITLE)} AS title,
    o_orderdate + to_minutes((20 + o_orderkey % 4) * 60 + 30) AS date,
    coalesce(nullif({_sql(_VENUE)}, ''), 'Unknown Venue') AS venue_name,
    CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE '€' || (o_orderkey % 40) END AS price,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.t.gr/' || o_orderkey ELSE 'https://x.gr/' || o_orderkey END AS url
  FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0)"""


# --- an event site ---------------------------------------------------------

SITE = "https://live.example.gr"
_GENRES = ["indie rock", "techno", "late jazz", "post-punk and pop", "quiet noise"]
_GENRE = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(_GENRES)) + " END"
_HALL = "CASE WHEN o_orderkey % 19 = 0 THEN 'Thessaloniki Hall' ELSE 'Hall ' || (o_custkey % 300) END"
_SITE_PRICE = "CASE o_orderkey % 4 WHEN 0 THEN '€' || (o_orderkey % 40) || '-€50' WHEN 1 THEN 'Free entry' WHEN 2 THEN '12,50 EUR' ELSE 'at the door' END"


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per order; every second one is long, some name no date."""
    return spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").selectExpr(
        f"'{SITE}/event/' || o_orderkey AS url",
        f"""concat('<html><body><article><h1>Act ', o_custkey % 50, ' @ ', {_HALL}, '</h1><p>',
            CASE WHEN o_orderkey % 23 = 0 THEN 'soon'
                 ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T2', o_orderkey % 4, ':30') END,
            '</p><p>', {_SITE_PRICE}, '</p><p>', {_GENRE}, '</p><p><a class="t" href="https://www.more.com/t/', o_orderkey,
            '">Tickets</a></p><p>', CASE WHEN o_orderkey % 2 = 0 THEN repeat('Doors open early. ', 60) ELSE 'Doors open.' END,
            '</p></article><nav><a href="/about">About</a></nav></body></html>') AS html""")


def agenda_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing page per 20 order keys, linking to their detail pages."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.expr("o_orderkey div 20").alias("b"))
            .agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
            .selectExpr("b", f"'{SITE}/agenda/' || b || '/' AS url",
                        """concat('<html><body><a href="/calendar/">Calendar</a><ul>',
                           array_join(transform(ks, k -> concat('<li><a href="/event/', k, '">', k, '</a></li>')), ''),
                           '</ul></body></html>') AS html"""))


# Five ways to write a line of an agenda: dates first or last, with stops, without, or with bars; every
# fifth page mixes two of them.
AGENDA_STYLES = 5


def written_agendas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per four order keys that announces them all: (b, html)."""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    name = "concat('Band ', o_orderkey, ' at Hall ', o_custkey % 300)"
    price = "concat('€', 1 + o_orderkey % 40)"
    line = f"""CASE (o_orderkey div 4) % {AGENDA_STYLES}
        WHEN 0 THEN concat('<li>', {day}, ' ', {name}, ' ', {price}, '.</li>')
        WHEN 1 THEN concat('<li>', {name}, ' <b>', {day}, '</b> ', {price}, '</li>')
        WHEN 2 THEN concat('<li>', {day}, ' | Band ', o_orderkey, ' | Hall ', o_custkey % 300, ' | ', {price}, ' |</li>')
        WHEN 3 THEN concat('<li>Band ', o_orderkey, ' | Hall ', o_custkey % 300, ' | ', {day}, ' | ', {price}, ' |</li>')
        ELSE CASE WHEN o_orderkey % 2 = 0 THEN concat('<li>', {name}, ' ', {day}, ' ', {price}, '.</li>')
             ELSE concat('<li>', {day}, ' ', {name}, ' ', {price}, '.</li>') END END"""
    return (spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
            .groupBy(F.expr("o_orderkey div 4").alias("b"))
            .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(line).alias("line")))).alias("lines"))
            .selectExpr("b", "concat('<html><body><article><ul>', array_join(transform(lines, l -> l.line), ' '), '</ul></article></body></html>') AS html"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda_pages(spark, sf_dir).select("url", "html").unionByName(event_pages(spark, sf_dir))


def site_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits: every agenda page, 20 to a query, each found twice."""
    found = (table(spark, sf_dir, "orders").selectExpr("o_orderkey div 20 AS b").distinct()
             .selectExpr("CAST(b div 10 AS INT) AS query_idx", "CAST(b % 10 AS INT) AS rank",
                         f"'{SITE}/agenda/' || b || '/' AS url", "'Concerts ' || b AS title",
                         "CAST(NULL AS STRING) AS description"))
    again = found.selectExpr("query_idx", "rank + 10 AS rank", "url", "'Again' AS title", "description")
    return found.unionByName(again)


# Records the site must give, in reading order; needs `orders`. Stored rows as in
# RECORDS_SQL.
SITE_SQL = f"""{GIGS_SQL}, {VENUES_SQL},
stored AS (SELECT g.* FROM gigs g JOIN orders o ON g.id = o.o_orderkey WHERE o.o_orderstatus = 'F'),
site AS (
  SELECT row_number() OVER (ORDER BY md5('0' || '{SITE}/event/' || o_orderkey)) AS i, o_orderkey, o_orderdate, o_custkey
  FROM orders),
found AS (
  SELECT i, o_orderkey, 'Act ' || (o_custkey % 50) AS title,
    timezone('UTC', timezone('Europe/Athens', o_orderdate + to_minutes((20 + o_orderkey % 4) * 60 + 30))) AS date,
    {_HALL} AS venue_name, {_SITE_PRICE} AS raw_price, {_GENRE} AS genre,
    CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.more.com/t/' || o_orderkey ELSE '{SITE}/event/' || o_orderkey END AS url
  FROM site WHERE o_orderkey % 23 <> 0),
chosen AS (
  SELECT *, (i - 1) // 2 AS batch FROM found
  WHERE date >= TIMESTAMP '1996-01-01' AND genre IN ('indie rock', 'late jazz', 'quiet noise')
    AND venue_name <> 'Thessaloniki Hall'),
records AS (
  SELECT i, title, date, venue_name,
    CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 40 > 0 THEN '€' || (o_orderkey % 40) END
      WHEN 1 THEN 'Free' WHEN 2 THEN '€12' END AS price, url, CAST(NULL AS VARCHAR) AS description
  FROM chosen
  QUALIFY row_number() OVER (PARTITION BY batch, lower(title), CAST(date AS DATE) ORDER BY i) = 1)"""
