"""Every query, next to the SQL it must agree with.

`QUERIES[name]` takes (spark, sf_dir); `ORACLES[name]` is DuckDB SQL over the same
tables. Instants are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions import base, dates, html, rules, text
from playbill.operators import extraction, frontier, keyed, listing, reconcile
from playbill.plans import sync
from playbill.session import materialize, new_work_dir
from playbill.sources import pages as page_source
from playbill.sources import responses, seed, store
from playbill.streaming.incremental import start_incremental
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "1998-01-15"
ZONE = dates.DEFAULT_ZONE


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def stamp(at: Column | str) -> Column:
    return dates.iso_utc(F.col(at) if isinstance(at, str) else at)


STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
# Host and origin of a page address, and percent-encoding, in SQL.
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
SPACES = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def sql_encode(expr: str) -> str:
    return (f"list_aggregate(list_transform(string_split({expr}, ''), "
            "lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), 'string_agg', '')")


def sql_untag(expr: str) -> str:
    code = (rf"regexp_replace(regexp_replace({expr}, '(?is)<script[^>]*>.*?</script>', '', 'g'), "
            r"'(?is)<style[^>]*>.*?</style>', '', 'g')")
    return rf"trim(regexp_replace(regexp_replace({code}, '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g'))"


ANCHOR = rf"""(?is)<a{SPACES[:-1]}[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""


def sql_linked(expr: str) -> str:
    return sql_untag(rf"regexp_replace({expr}, '{ANCHOR}', '\2 (\1)', 'g')")


MAIN = r"regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1)"
# All same-host links of a page, in order; the given pages only hold root-relative ones.
LINKS_SQL = rf"""hrefs AS (
  SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS n
  FROM (SELECT page_id, url, regexp_extract_all(
          regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), 'href="(/[^"]*)"', 1) AS l FROM pages)),
links AS (
  SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos
  FROM (SELECT page_id, url, {ORIGIN.replace("url", "hrefs.url")} || {sql_encode("href")} AS link, min(n) AS n
        FROM hrefs GROUP BY ALL))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.spread_table(spark, sf_dir, "pages", "page_id", "url", "html")


# --- sources ---------------------------------------------------------------

def _search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search response per page: the page and its host; some have no results."""
    return t.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("int").alias("query_idx"),
        F.when(F.col("page_id") % 7 == 0, '{"web":{}}').when(F.col("page_id") % 11 == 0, "{}").otherwise(
            F.to_json(F.struct(F.struct(F.array(
                F.struct("url", F.lit("page").alias("title"), F.lit("x").alias("description")),
                F.struct(html.hostname(F.col("url")).alias("url"), F.lit("host").alias("title"),
                         F.lit(None).cast("string").alias("description")),
            ).alias("results")).alias("web")))).alias("response"))


@query(f"""SELECT CAST(page_id AS INTEGER) AS query_idx, r AS rank,
  CASE r WHEN 0 THEN url ELSE {HOST} END AS url, CASE r WHEN 0 THEN 'page' ELSE 'host' END AS title,
  CASE r WHEN 0 THEN 'x' END AS description
FROM pages, (SELECT unnest([0, 1]) AS r) WHERE page_id % 7 <> 0 AND page_id % 11 <> 0""")
def search_responses(spark, sf_dir):
    return frontier.project_hits(
        responses.parse_search_responses(_search_texts(spark, sf_dir), "response", "query_idx"))


@query(f"""WITH {LINKS_SQL}
SELECT page_id, p.url, {sql_linked(MAIN)} AS text, html AS raw_html, TRUE AS success,
  (SELECT count(*) FROM links l WHERE l.page_id = p.page_id) AS n_links FROM pages p""")
def scraped_pages(spark, sf_dir):
    return page_source.successful(page_source.scrape_rows(_pages(spark, sf_dir))).select(
        "page_id", "url", "text", "raw_html", "success", F.size("links").cast("bigint").alias("n_links"))


@query("SELECT count(*) AS successful, CAST(0 AS BIGINT) AS failed, count(*) AS total FROM pages")
def scrape_counts(spark, sf_dir):
    return page_source.scrape_counts(page_source.scrape_rows(_pages(spark, sf_dir)))


@query(f"""WITH {t.GIGS_SQL}, {t.VENUES_SQL}
SELECT 'gig' AS kind, id, title AS name, {STAMP.format("date")} AS at, strftime(date, '%Y-%m') AS month FROM gigs
UNION ALL SELECT 'venue', id, name, NULL, NULL FROM venues""")
def store_roundtrip(spark, sf_dir):
    db = store.Store(spark, new_work_dir(spark, "store"))
    db.append(t.gigs(spark, sf_dir), t.venues(spark, sf_dir))
    gigs = db.gigs().select(F.lit("gig").alias("kind"), "id", F.col("title").alias("name"),
                            stamp("date").alias("at"), "month")
    blank = F.lit(None).cast("string")
    return gigs.unionByName(db.venues().select(
        F.lit("venue").alias("kind"), "id", "name", blank.alias("at"), blank.alias("month")))


@query(f"""WITH {t.GIGS_SQL}
SELECT count(*) FILTER (manual IS NOT TRUE) AS deleted, count(*) FILTER (manual IS TRUE) AS kept FROM gigs""")
def clear_gigs(spark, sf_dir):
    kept, deleted = reconcile.clear_non_manual(t.gigs(spark, sf_dir))
    return deleted.withColumn("kept", kept.agg(F.count(F.lit(1)).alias("n")).scalar())


@query(f"""WITH {t.GIGS_SQL} SELECT id, title FROM gigs WHERE manual IS TRUE""")
def manual_gigs(spark, sf_dir):
    return reconcile.clear_non_manual(t.gigs(spark, sf_dir))[0].select("id", "title")


@query(f"""WITH {t.PARSED_SQL} SELECT batch, 0 AS pos, title, {STAMP.format("date")} AS at, venue_name, price, url FROM parsed""")
def model_responses(spark, sf_dir):
    parsed = responses.parse_gig_responses(t.responses(spark, sf_dir), "response", "batch")
    return extraction.valid_dates(extraction.normalize_gigs(parsed)).select(
        "batch", "pos", "title", stamp("date").alias("at"), "venue_name", "price", "url")


def _lists(spark, sf_dir, field):
    row = F.struct(F.array("url", F.concat("url", F.lit("?b"))).alias(field))
    return t.table(spark, sf_dir, "pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, "oops").otherwise(F.to_json(row)).alias("response"))


_LIST_SQL = """SELECT page_id, r AS pos, CASE r WHEN 0 THEN url ELSE url || '?b' END AS url
FROM pages, (SELECT unnest([0, 1]) AS r) WHERE page_id % 5 <> 0"""


@query(_LIST_SQL)
def url_selections(spark, sf_dir):
    return responses.parse_url_list(_lists(spark, sf_dir, "promising_urls"), "response", "promising_urls", "page_id")


@query(_LIST_SQL)
def link_selections(spark, sf_dir):
    return responses.parse_url_list(
        _lists(spark, sf_dir, "event_detail_urls"), "response", "event_detail_urls", "page_id")


_EXTRA = [*seed.EXTRA_URLS, "https://m.ththth.example.net/en/25#top"]


@query(f"""SELECT url FROM pages UNION SELECT unnest({_EXTRA})""")
def extra_sources(spark, sf_dir):
    return frontier.add_if_absent(frontier.distinct_urls(t.table(spark, sf_dir, "pages")), _EXTRA)


# --- scalar functions ------------------------------------------------------

_AMOUNT = """SELECT l_orderkey, l_linenumber, k, trim(raw, E' \\t\\n') AS p FROM (
  SELECT *, """ + t.PRICE_CASE + """ AS raw FROM (
    SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS k, CAST(l_quantity AS BIGINT) AS n FROM lineitem))"""


@query(f"""SELECT l_orderkey, l_linenumber, price, try_cast(nullif(regexp_extract(price, '^€(\\d+)$', 1), '') AS VARCHAR) AS eur FROM (
SELECT l_orderkey, l_linenumber, CASE
    WHEN p IS NULL OR p IN ('', 'N/A', '€', 'EUR') THEN NULL
    WHEN regexp_matches(p, '(?i)sold\\s*out') THEN 'Sold Out'
    WHEN p ILIKE '%free%' THEN 'Free'
    WHEN floor(list_min(v)) > 0 THEN '€' || CAST(floor(list_min(v)) AS BIGINT) END AS price
FROM (SELECT *, list_transform(regexp_extract_all(p, '\\d+[.,]\\d+|\\d+'),
        lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS v FROM ({_AMOUNT})))""")
def prices(spark, sf_dir):
    lines = t.spread_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").selectExpr(
        "l_orderkey", "l_linenumber", "l_orderkey * 7 + l_linenumber AS k", "CAST(l_quantity AS BIGINT) AS n")
    price = text.normalize_price(F.expr(t.PRICE_CASE.replace("VARCHAR(9)", "STRING")))
    priced = lines.select("l_orderkey", "l_linenumber", price.alias("price"))
    return priced.withColumn("eur", text.price_eur(F.col("price")).cast("string"))


_URL_CASE = ("CASE o_orderkey % 8 WHEN 0 THEN 'http://x.gr/' || o_orderkey WHEN 1 THEN 'HTTPS://X' || o_orderkey "
             "WHEN 2 THEN 'www.x' || o_orderkey || '.gr' WHEN 3 THEN ' x' || o_orderkey || '.gr/e ' "
             "WHEN 4 THEN 'tickets' WHEN 5 THEN '' WHEN 6 THEN 'a b.c' END")


@query("""SELECT o_orderkey, u AS url, coalesce(u, 'https://y.gr') AS batch_url, coalesce(u, 'https://page') AS page_url,
  coalesce(u, '') AS bare_url
FROM (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'http://x.gr/' || o_orderkey WHEN 1 THEN 'HTTPS://X' || o_orderkey
  WHEN 2 THEN 'https://www.x' || o_orderkey || '.gr' WHEN 3 THEN 'https://x' || o_orderkey || '.gr/e' END AS u FROM orders)""")
def urls(spark, sf_dir):
    raw = F.expr(_URL_CASE)
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.normalize_url(raw).alias("url"),
        text.gig_url(raw, F.lit("y.gr")).alias("batch_url"),
        text.gig_url_on_page(raw, F.lit("https://page")).alias("page_url"),
        text.gig_url(raw, F.lit("no address")).alias("bare_url"))


@query("""SELECT o_orderkey, 'Band ' || o_custkey AS title,
  CASE WHEN o_custkey % 4 < 2 THEN 'Unknown Venue' ELSE 'Hall ' || o_custkey END AS venue,
  replace(lower('ΟΔΟΣ ' || o_orderpriority || ' ΑΣ'), 'ς', 'σ') AS key FROM orders""")
def names(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.clean_title(F.expr("'Band ' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN ' @ STEGI' WHEN 1 THEN "
                                "' at Venue' WHEN 2 THEN '@Η Αυλή' ELSE '' END")).alias("title"),
        text.venue_or_default(F.expr("CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' "
                                     "ELSE 'Hall ' || o_custkey END")).alias("venue"),
        text.name_key(F.concat(F.lit("ΟΔΟΣ "), "o_orderpriority", F.lit(" ΑΣ"))).alias("key"))


@query("""SELECT p_partkey, 'URL: https://x.gr/' || p_partkey || chr(10) || 'Title: ' || p_name || chr(10) || 'Description: ' ||
  CASE WHEN p_size % 3 = 0 THEN 'N/A' ELSE p_type END AS hit FROM part""")
def hit_texts(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", text.hit_text(
        F.expr("'https://x.gr/' || p_partkey"), F.col("p_name"),
        F.expr("CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END")).alias("hit"))


@query(f"""WITH {t.GIGS_SQL}, {t.VENUES_SQL}
SELECT g.id, CASE WHEN nullif(g.url, '') IS NOT NULL THEN coalesce(g.price, 'Info') ELSE coalesce(g.price, '—') END AS desktop,
  CASE WHEN nullif(g.url, '') IS NOT NULL THEN coalesce(g.price, 'Info') ELSE g.price END AS mobile,
  v.name AS venue, nullif(v.website, '') AS venue_link
FROM gigs g LEFT JOIN venues v ON v.id = g.venue_id""")
def labels(spark, sf_dir):
    rows = listing.populate_venue(t.gigs(spark, sf_dir), t.venues(spark, sf_dir))
    label = text.venue_label(F.col("venue_name"), F.col("venue_website"))
    return rows.select("id", text.price_label(F.col("price"), F.col("url")).alias("desktop"),
                       text.price_label(F.col("price"), F.col("url"), "mobile").alias("mobile"),
                       label["name"].alias("venue"), label["website"].alias("venue_link"))


_TEXT_LENGTH = r"length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))"


@query(f"""SELECT doc_id, {_TEXT_LENGTH} AS units, substr(text, 1, 5000) AS batch_text, md5(substr(text, 1, 50000)) AS page_md5,
  substr(text, 1, 255) AS title_fit FROM documents""")
def text_budgets(spark, sf_dir):
    body = F.col("text")
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", base.utf16_length(body).cast("bigint").alias("units"),
        base.truncate(body, html.BATCH_BUDGET).alias("batch_text"),
        F.md5(base.truncate(body, html.PAGE_BUDGET)).alias("page_md5"),
        text.fit(body, 255).alias("title_fit"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN '[{"title":"' || o_custkey || '"}]' END AS body FROM orders""")
def citations(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN 'none <citation>[' || o_orderkey || ']</citation>'
        WHEN 1 THEN 'Here: [{"title":"' || o_custkey || '"}] <citation>{"index":[1]}</citation>'
        ELSE '<usage>[9]</usage>[{"title":"' || o_custkey || '"}]' END""")
    return t.table(spark, sf_dir, "orders").select("o_orderkey", text.strip_citations(raw).alias("body"))


_WHEN = "l_shipdate + to_minutes((10 + l_linenumber) * 60 + 5)"
_LOCAL = "timezone('UTC', timezone('Europe/Athens', {}))"


@query(f"""SELECT l_orderkey, l_linenumber, {STAMP.format("parsed")} AS at FROM (
SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 14
  WHEN 0 THEN l_shipdate WHEN 1 THEN date_trunc('month', l_shipdate) WHEN 2 THEN {_LOCAL.format("w")} WHEN 3 THEN w
  WHEN 4 THEN w - INTERVAL 2 HOUR WHEN 5 THEN {_LOCAL.format("l_shipdate")}
  WHEN 6 THEN CASE WHEN day(l_shipdate) <= 12 THEN {_LOCAL.format("make_timestamp(year(l_shipdate), day(l_shipdate), month(l_shipdate), 0, 0, 0)")}
              ELSE {_LOCAL.format("l_shipdate")} END
  WHEN 7 THEN {_LOCAL.format("w")} WHEN 8 THEN {_LOCAL.format("l_shipdate")} WHEN 9 THEN {_LOCAL.format("l_shipdate")}
  WHEN 10 THEN {_LOCAL.format("date_trunc('month', l_shipdate) + INTERVAL 31 DAY")}
  WHEN 11 THEN NULL WHEN 12 THEN {_LOCAL.format("make_timestamp(year(l_shipdate) + 1, 1, day(l_shipdate), 0, 0, 0)")}
  ELSE w + INTERVAL 5 HOUR END AS parsed
FROM (SELECT *, {_WHEN} AS w FROM lineitem))""")
def flexible_dates(spark, sf_dir):
    lines = t.spread_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").withColumn(
        "w", F.expr("l_shipdate + make_dt_interval(0, CAST(10 + l_linenumber AS INT), 5)"))
    day, at = F.col("l_shipdate"), F.col("w")
    shapes = [
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format(at, "yyyy-MM-dd'T'HH:mm'+02:00'"),
        F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd-MM-yyyy"), F.date_format(at, "MMM d yyyy HH:mm"),
        F.date_format(day, "d MMMM yyyy"), F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "yyyy-MM-'32'"),
        F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "yyyy-'13'-dd"),
        F.date_format(at, "EEE, d MMM yyyy HH:mm:ss '-0500'"),
    ]
    chosen = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        chosen = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % len(shapes) == i, shape).otherwise(chosen)
    return lines.select("l_orderkey", "l_linenumber",
                        stamp(dates.parse_flexible_date(chosen, ZONE)).alias("at"))


@query(f"""WITH {t.GIGS_SQL}, local AS (SELECT *, timezone('Europe/Athens', timezone('UTC', date)) AS z FROM gigs)
SELECT id, {STAMP.format("date")} AS iso, CAST(CAST(date AS DATE) AS VARCHAR) AS utc_day, strftime(z, '%Y-%m') AS month_key,
  strftime(z, '%B') AS month_label, strftime(z, '%a') AS weekday,
  day(z) || CASE WHEN day(z) IN (11, 12, 13) THEN 'th' WHEN day(z) % 10 = 1 THEN 'st' WHEN day(z) % 10 = 2 THEN 'nd'
                 WHEN day(z) % 10 = 3 THEN 'rd' ELSE 'th' END AS day,
  CASE WHEN month(date) = month(CAST(date AS DATE) + 30) THEN strftime(date, '%B %Y')
       ELSE strftime(date, '%B') || '-' || strftime(CAST(date AS DATE) + 30, '%B %Y') END AS range_label,
  date >= TIMESTAMP '{AS_OF}' AS future
FROM local""")
def date_fields(spark, sf_dir):
    at = F.col("date")
    label = dates.day_label(at)
    return t.gigs(spark, sf_dir).select(
        "id", stamp(at).alias("iso"), dates.utc_day(at).cast("string").alias("utc_day"), dates.month_key(at).alias("month_key"),
        dates.month_label(dates.month_key(at)).alias("month_label"), label["weekday"].alias("weekday"),
        label["day"].alias("day"), dates.date_range_label(dates.utc_day(at)).alias("range_label"),
        dates.is_future(at, AS_OF).alias("future"))


@query(f"""WITH {t.GIGS_SQL} SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS day, count(*) AS gigs FROM gigs
WHERE date >= TIMESTAMP '{AS_OF}' AND date < TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY GROUP BY 1""")
def one_day(spark, sf_dir):
    since, until = dates.day_bounds(F.lit(AS_OF).cast("date"))
    rows = t.gigs(spark, sf_dir).where((F.col("date") >= since) & (F.col("date") < until))
    return rows.groupBy(dates.utc_day(F.col("date")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("gigs"))


# --- pages -----------------------------------------------------------------

@query(f"WITH {LINKS_SQL} SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM links")
def links_of_pages(spark, sf_dir):
    return frontier.with_links(_pages(spark, sf_dir)).select(
        "page_id", F.posexplode("links").alias("pos", "link"))


@query(f"SELECT page_id, {sql_linked('html')} AS text FROM pages")
def text_keeping_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.text_with_links(F.col("html")).alias("text"))


@query(f"SELECT page_id, {sql_untag('html')} AS text FROM pages")
def stripped_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.strip_html(F.col("html")).alias("text"))


@query(f"SELECT page_id, {MAIN} AS main FROM pages")
def main_parts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.main_content(F.col("html")).alias("main"))


_CONTENT = f"""SELECT page_id, url, CASE WHEN length(x) < 1000 THEN {sql_untag('html')} ELSE x END AS content
FROM (SELECT *, {sql_linked(MAIN)} AS x FROM pages)"""


@query(f"{_CONTENT} WHERE length(x) > 0")
def page_content(spark, sf_dir):
    pages = page_source.with_text(page_source.scrape_rows(_pages(spark, sf_dir)))
    return pages.select("page_id", "url", html.choose_content(F.col("text"), F.col("raw_html")).alias("content"))


@query(f"SELECT page_id, substr(content, 1, 5000) AS content FROM ({_CONTENT})")
def prompt_contents(spark, sf_dir):
    pages = page_source.scrape_rows(_pages(spark, sf_dir))
    return pages.select("page_id", html.prompt_content(F.col("text"), F.col("raw_html")).alias("content"))


# --- frontier --------------------------------------------------------------

def _hits(spark, sf_dir):
    """Orders as search hits: the customer is the query, the part of the key the page."""
    return t.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS INT) AS query_idx", "CAST(o_orderkey AS INT) AS rank",
        "'https://h' || (o_custkey % 40) || '.gr/' || (o_orderkey % 700) AS url",
        "'Hit ' || o_orderkey AS title", "o_orderpriority AS description")


_HITS_SQL = """hits AS (SELECT CAST(o_custkey AS INTEGER) AS query_idx, CAST(o_orderkey AS INTEGER) AS rank,
  'https://h' || (o_custkey % 40) || '.gr/' || (o_orderkey % 700) AS url, 'Hit ' || o_orderkey AS title,
  o_orderpriority AS description FROM orders)"""


@query(f"WITH {_HITS_SQL} SELECT * FROM hits UNION ALL SELECT query_idx + 1000000, rank, url, title, description FROM hits")
def merged_hits(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return frontier.merge_hits(hits, hits.withColumn("query_idx", F.col("query_idx") + 1000000))


@query(f"WITH {_HITS_SQL} SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY rank) <= 20")
def capped_hits(spark, sf_dir):
    return frontier.cap_hits(_hits(spark, sf_dir), 20)


@query(f"WITH {_HITS_SQL} SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_idx, rank) = 1")
def first_hits(spark, sf_dir):
    return frontier.unique_hits(_hits(spark, sf_dir))


@query(f"WITH {_HITS_SQL} SELECT DISTINCT url FROM hits")
def unique_urls(spark, sf_dir):
    return frontier.distinct_urls(_hits(spark, sf_dir))


def _source_hits(spark, sf_dir):
    sites = ["viva.gr", "www.more.com", "songkick.com", "facebook.com", "viagogo.com", "blog.gr", "hall.gr", "kafe.gr"]
    names = F.array(*[F.lit(s) for s in sites])
    return t.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 3).cast("int").alias("query_idx"), F.col("p_partkey").cast("int").alias("rank"),
        F.concat(F.lit("https://"), F.element_at(names, (F.col("p_size") % 8 + 1).cast("int")), F.lit("/"),
                 F.col("p_partkey")).alias("url"),
        F.concat("p_name", F.expr("CASE p_partkey % 10 WHEN 3 THEN ' techno' WHEN 4 THEN ' Patras' "
                                  "WHEN 5 THEN ' past events' ELSE ' rock' END")).alias("title"),
        F.col("p_type").alias("description"))


_SOURCES_SQL = """ranked AS (
  SELECT *, CASE s WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 6 THEN 2 ELSE 4 END AS tier
  FROM (SELECT CAST(p_partkey % 3 AS INTEGER) AS query_idx, CAST(p_partkey AS INTEGER) AS rank, p_size % 8 AS s,
          'https://' || ['viva.gr','www.more.com','songkick.com','facebook.com','viagogo.com','blog.gr','hall.gr','kafe.gr'][p_size % 8 + 1]
            || '/' || p_partkey AS url
        FROM part WHERE p_partkey % 10 NOT IN (3, 4, 5)) WHERE s NOT IN (3, 4))"""
_TIERS = {**frontier.SITE_TIERS, "hall.gr": 2}


@query(f"""WITH {_SOURCES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY tier, query_idx, rank, url) AS n FROM ranked)
SELECT url, tier FROM r ORDER BY tier >= 5, n, tier, query_idx, rank, url LIMIT 10""")
def best_sources(spark, sf_dir):
    return frontier.rank_sources(_source_hits(spark, sf_dir), _TIERS, n=10).select("url", "tier")


@query(f"WITH {_SOURCES_SQL} SELECT url, tier FROM ranked")
def ranked_sources(spark, sf_dir):
    tiers = t.table(spark, sf_dir, "nation").selectExpr("'nation' || n_nationkey || '.gr' AS host", "1 AS tier")
    listed = spark.createDataFrame(list(_TIERS.items()), "host string, tier int")
    return frontier.rank_sources(_source_hits(spark, sf_dir), listed.unionByName(tiers), n=None).select("url", "tier")


def _two_letters(url: Column) -> Column:
    """A link rule for the given pages, whose links are bare words."""
    return F.lower(rules.url_path(url)).rlike(r"\A/[a-z]{2,3}\z")


@query(f"""WITH {LINKS_SQL} SELECT page_id, string_agg((n) || '. ' || link, chr(10) ORDER BY n) AS picked FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM links
  WHERE regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '^/[a-z]{{2,3}}$')) GROUP BY 1""")
def event_links(spark, sf_dir):
    pages = frontier.with_links(_pages(spark, sf_dir))
    picked = pages.select("page_id", frontier.event_links(F.col("links"), _two_letters).alias("links"))
    return picked.where(F.size("links") > 0).select("page_id", text.numbered(F.col("links")).alias("picked"))


@query("""SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 3, 4) AS event FROM orders""")
def event_link_rule(spark, sf_dir):
    paths = ("CASE o_orderkey % 8 WHEN 0 THEN '/event/a' || o_orderkey WHEN 1 THEN '/Concert/b' WHEN 2 THEN '/gig/1?x=/events' "
             "WHEN 3 THEN '/el/show/z' WHEN 4 THEN '/t/' || o_orderkey WHEN 5 THEN '/events/' || o_orderkey "
             "WHEN 6 THEN '/category/event/' || o_orderkey ELSE '/about' END")
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey", rules.is_event_link(F.concat(F.lit("https://x.gr"), F.expr(paths))).alias("event"))


_ROUTED_SQL = f"""{LINKS_SQL}, routed AS (
  SELECT link AS url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM links
    WHERE regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '^/[a-z]{{2,3}}$'))
  UNION ALL SELECT url FROM pages WHERE page_id NOT IN (SELECT page_id FROM links))"""


@query(f"WITH {_ROUTED_SQL} SELECT url, count(*) AS n FROM routed GROUP BY 1")
def routed_pages(spark, sf_dir):
    pages = frontier.with_links(_pages(spark, sf_dir))
    return frontier.route_pages(pages, _two_letters).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT url, md5('7' || url) AS sample_key FROM (SELECT DISTINCT url FROM pages) ORDER BY 2, 1 LIMIT 100")
def sampled_urls(spark, sf_dir):
    return frontier.sample_urls(frontier.distinct_urls(t.table(spark, sf_dir, "pages")), n=100, seed="7")


@query(f"WITH {_ROUTED_SQL} SELECT url, md5('0' || url) AS sample_key FROM (SELECT DISTINCT url FROM routed) ORDER BY 2, 1 LIMIT 100")
def crawl_frontier(spark, sf_dir):
    return sync.crawl_frontier(_pages(spark, sf_dir), n=100, rule=_two_letters)


@query(f"WITH {_ROUTED_SQL} SELECT DISTINCT url, md5('0' || url) AS sample_key FROM routed")
def whole_frontier(spark, sf_dir):
    return sync.crawl_frontier(_pages(spark, sf_dir), n=None, rule=_two_letters)


# --- extraction ------------------------------------------------------------

def _chunks(spark, sf_dir):
    docs = t.spread_table(spark, sf_dir, "documents", "doc_id", "text").where(F.length("text") > 0).select(
        "doc_id", F.concat(F.lit("doc:"), "doc_id").alias("url"), F.col("text").alias("content"))
    return extraction.chunk(docs, ["doc_id"], keyed.id_range(F.col("doc_id"), 64))


_CHUNKS_SQL = """chunks AS (SELECT doc_id, 'doc:' || doc_id AS url, text AS content,
  (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 2 AS slot
  FROM documents WHERE length(text) > 0)"""


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, batch, CAST(slot AS INTEGER) AS slot FROM chunks")
def page_batches(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "batch", "slot")


_INTRO = ("List the upcoming concerts in the text below as JSON: {\"gigs\": [...]} with title, date, venue_name, description, "
          "price, ticket_url, url, image_url.")


@query(f"""WITH {_CHUNKS_SQL} SELECT batch, md5('{_INTRO}' || chr(10) || chr(10) || string_agg('--- page ' || (slot + 1) || ' ---' || chr(10) ||
  'Source: ' || url || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY slot)) AS prompt FROM chunks GROUP BY 1""")
def batch_prompts(spark, sf_dir):
    batches = extraction.collect_batches(_chunks(spark, sf_dir))
    return batches.select("batch", F.md5(extraction.render_prompt("batch", pages=F.col("pages"))).alias("prompt"))


@query(f"""SELECT doc_id, md5('{_INTRO}' || chr(10) || chr(10) || 'Source: doc:' || doc_id || chr(10) || chr(10) || substr(text, 1, 50000)) AS page_prompt,
  'Pick the 5 to 10 result pages most likely to list upcoming concerts in Athens.' || chr(10) || 'Answer with JSON: {{"promising_urls": [...]}}'
   || chr(10) || chr(10) || 'Results:' || chr(10) || chr(10) || 'URL: u' || chr(10) || 'Title: ' || source || chr(10) || 'Description: N/A' AS source_prompt,
  'Pick up to 20 links that lead to a single event.' || chr(10) || 'Answer with JSON: {{"event_detail_urls": [...]}}' || chr(10) || chr(10) ||
  'Page: p' || chr(10) || 'Title: ' || lang || chr(10) || 'Links (2):' || chr(10) || '1. ' || source || chr(10) || '2. ' || lang AS link_prompt
FROM documents""")
def prompts(spark, sf_dir):
    null = F.lit(None).cast("string")
    return t.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(extraction.render_prompt(
            "page", url=F.concat(F.lit("doc:"), "doc_id"),
            content=base.truncate(F.col("text"), html.PAGE_BUDGET))).alias("page_prompt"),
        extraction.render_prompt("sources", hits=text.hit_text(F.lit("u"), F.col("source"), null)).alias("source_prompt"),
        extraction.render_prompt("links", url=F.lit("p"), title=F.col("lang"),
                                 links=F.array("source", "lang")).alias("link_prompt"))


def _count_words(prompt: str) -> str:
    """A stand-in for a model call; it cannot answer prompts that say `###`."""
    if "###" in prompt:
        raise ValueError("unreadable prompt")
    return '{"gigs": [{"title": "%d words", "date": "2026-01-02"}]}' % len(prompt.split())


@query(f"""WITH {_CHUNKS_SQL} SELECT count(*) FILTER (bad = 0) AS successful, count(*) FILTER (bad > 0) AS failed
FROM (SELECT batch, count(*) FILTER (contains(content, '###')) AS bad FROM chunks GROUP BY 1)""")
def scored_batches(spark, sf_dir):
    return extraction.batch_counts(
        extraction.score_batches(extraction.collect_batches(_chunks(spark, sf_dir)), _count_words))


@query(r"""SELECT p_partkey, regexp_matches(x, '(^|[^\p{L}])(rock|metal|indie|alternative|folk|post[- ]?rock|shoegaze|dark|goth|post[- ]?punk|experimental|noise|ambient|jazz)([^\p{L}]|$)')
  AND NOT regexp_matches(x, '(^|[^\p{L}])(pop|dance|techno|house|rave|edm|hip[- ]?hop|trap|rap|λαϊκά|έντεχνο|mainstream)([^\p{L}]|$)') AS genre_ok,
  NOT regexp_matches(x, '(^|[^\p{L}])(thessaloniki|patras)([^\p{L}]|$)') AS city_ok
FROM (SELECT p_partkey, lower(p_name || ['rock','indie pop','rocks','Metal!','post punk','έντεχνο jazz','house','in Patras, folk'][p_partkey % 8 + 1]) AS x
      FROM (SELECT p_partkey, p_name || ' ' AS p_name FROM part))""")
def genre_and_city(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("rock", "indie pop", "rocks", "Metal!", "post punk", "έντεχνο jazz",
                                          "house", "in Patras, folk")])
    about = F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % 8 + 1).cast("int")))
    return t.table(spark, sf_dir, "part").select(
        "p_partkey", rules.genre_ok(about).alias("genre_ok"), rules.city_ok(about).alias("city_ok"))


@query("""SELECT o_orderkey, 'Act ' || j || ' @ Hall ' || (o_custkey % 300) AS title, '2026-0' || (j + 1) || '-1' || (o_orderkey % 10) AS date,
  'Hall ' || (o_custkey % 300) AS venue_name, '€' || (10 + j) AS price
FROM (SELECT o_orderkey, o_custkey, unnest(range(1 + o_orderkey % 5)) AS j FROM orders)""")
def page_events(spark, sf_dir):
    """Pages that announce one to five events, in one or several articles."""
    event = ("concat('<p>Act ', j, ' @ Hall ', o_custkey % 300, ' | 2026-0', j + 1, '-1', o_orderkey % 10, ' €', 10 + j, "
             "' loud songs.</p>', CASE WHEN o_orderkey % 2 = 0 THEN '</article> <article>' ELSE '' END)")
    pages = t.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(
        f"concat('<body><nav>About</nav><article>', array_join(transform(sequence(0, int(o_orderkey % 5)), j -> {event}), ' '), '</article></body>')").alias("html"))
    found = pages.select("o_orderkey", F.explode(extraction.extract_events(F.lit("u"), html.page_text(F.col("html")))).alias("e"))
    return found.select("o_orderkey", "e.title", "e.date", "e.venue_name", "e.price")


@query("""SELECT o_orderkey // 4 AS b, 'Band ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS date,
  'Hall ' || (o_custkey % 300) AS venue_name, '€' || (1 + o_orderkey % 40) AS price FROM orders""")
def agenda_events(spark, sf_dir):
    """The events of pages that write dates first, last or both."""
    pages = t.written_agendas(spark, sf_dir)
    found = pages.select("b", F.explode(extraction.extract_events(F.lit("u"), html.page_text(F.col("html")))).alias("e"))
    return found.select("b", text.clean_title(F.col("e.title")).alias("title"), "e.date", "e.venue_name", "e.price")


@query("""SELECT o_orderkey, count(*) AS links FROM (SELECT o_orderkey, unnest(range(o_orderkey % 60)) FROM orders) GROUP BY 1""")
def long_agendas(spark, sf_dir):
    """Event links of pages with up to 59 of them."""
    pages = t.spread_table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", F.expr(
        "'https://x.gr/a'").alias("url"), F.expr("array_join(transform(sequence(0, int(o_orderkey % 60)), "
        "j -> concat('<a href=\"/event/', j, '\">x</a><a href=\"/about\">y</a>')), '')").alias("html"))
    # Counted behind a generator: the filter would have the links of every page found a second time.
    picked = base.compute_once(frontier.with_links(pages).select("o_orderkey", "links"),
                               links=(F.size(frontier.event_links(F.col("links"))) - 1).cast("long"))
    return picked.where("links > 0")


@query("""SELECT batch, pos, title, CAST(CAST(date AS DATE) AS VARCHAR) AS day FROM (
  SELECT user_id AS batch, event_id AS pos, event_type AS title, ts AS date FROM events)
QUALIFY row_number() OVER (PARTITION BY batch, title, CAST(date AS DATE) ORDER BY pos) = 1""")
def unique_in_batch(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), F.col("event_type").alias("title"),
        F.col("ts").alias("date"))
    return extraction.dedupe_in_batch(rows).select("batch", "pos", "title", dates.utc_day(F.col("date")).cast("string").alias("day"))


@query(f"""WITH {t.PARSED_SQL} SELECT title, count(*) AS n, min({STAMP.format("date")}) AS first_at FROM parsed GROUP BY 1""")
def merged_gigs(spark, sf_dir):
    texts = t.responses(spark, sf_dir)
    parts = [extraction.candidates(texts.where(F.col("batch") % 2 == half)) for half in (0, 1)]
    return extraction.merge_gigs(*parts).groupBy("title").agg(
        F.count(F.lit(1)).alias("n"), F.min(stamp("date")).alias("first_at"))


# --- storing ---------------------------------------------------------------

_REASON = """CASE WHEN title IS NULL THEN 'title_missing' WHEN length(title) > 255 THEN 'title_too_long'
  WHEN length(venue_name) > 255 THEN 'venue_too_long' END"""


@query(f"WITH {t.RECORDS_SQL} SELECT i, reason FROM (SELECT i, {_REASON} AS reason FROM records) WHERE reason IS NOT NULL")
def rejected_records(spark, sf_dir):
    rows = t.records(spark, sf_dir)
    reason = F.coalesce(reconcile.gig_reason(rows.columns), reconcile.venue_reason("venue_name"))
    return reconcile.split_valid(rows, reason)[1].select("i", "reason")


@query(f"WITH {t.RECORDS_SQL} SELECT i, title FROM (SELECT *, {_REASON} AS reason FROM records) WHERE reason IS NULL")
def accepted_records(spark, sf_dir):
    rows = t.records(spark, sf_dir)
    reason = F.coalesce(reconcile.gig_reason(rows.columns), reconcile.venue_reason("venue_name"))
    return reconcile.split_valid(rows, reason)[0].select("i", "title")


def _reconciled(spark, sf_dir, stage=materialize):
    return reconcile.reconcile(t.records(spark, sf_dir), t.stored_gigs(spark, sf_dir), t.venues(spark, sf_dir), stage)


@query(f"WITH {t.RECORDS_SQL}, {t.OUTCOMES_SQL} SELECT i, outcome, reason FROM outcomes")
def record_outcomes(spark, sf_dir):
    return reconcile.gig_outcomes(t.records(spark, sf_dir), t.stored_gigs(spark, sf_dir)).select("i", "outcome", "reason")


@query(f"WITH {t.RECORDS_SQL}, {t.OUTCOMES_SQL} SELECT id, name FROM new_venues")
def new_venues(spark, sf_dir):
    return _reconciled(spark, sf_dir).venues.select("id", "name")


@query(f"WITH {t.RECORDS_SQL}, {t.OUTCOMES_SQL} SELECT id, title, {STAMP.format('date')} AS at, price, url, venue_id FROM new_gigs")
def new_gigs(spark, sf_dir):
    return _reconciled(spark, sf_dir).gigs.select("id", "title", stamp("date").alias("at"), "price", "url", "venue_id")


@query(f"""WITH {t.RECORDS_SQL}, {t.OUTCOMES_SQL} SELECT count(*) AS gigs_extracted, count(*) FILTER (outcome = 'created') AS gigs_created,
  count(*) FILTER (outcome = 'skipped') AS gigs_skipped, count(*) FILTER (outcome = 'error') AS errors FROM outcomes""")
def outcome_counts(spark, sf_dir):
    return reconcile.outcome_counts(reconcile.gig_outcomes(t.records(spark, sf_dir), t.stored_gigs(spark, sf_dir)))


@query(f"""WITH {t.GIGS_SQL} SELECT title, {STAMP.format("date")} AS date, CAST(venue_id AS VARCHAR) AS venue, description, price, url FROM gigs""")
def gig_payloads(spark, sf_dir):
    return reconcile.to_gig_rows(t.gigs(spark, sf_dir)).withColumn("venue", F.col("venue").cast("string"))


@query(f"WITH {t.VENUES_SQL} SELECT name, address, website FROM venues")
def venue_payloads(spark, sf_dir):
    return reconcile.to_venue_rows(t.venues(spark, sf_dir))


# --- listing ---------------------------------------------------------------

@query(f"WITH {t.GIGS_SQL} SELECT id, {STAMP.format('date')} AS at FROM gigs WHERE date >= TIMESTAMP '{AS_OF}'")
def upcoming_gigs(spark, sf_dir):
    return listing.upcoming(t.gigs(spark, sf_dir), AS_OF).select("id", stamp("date").alias("at"))


@query(f"""WITH {t.GIGS_SQL}, {t.VENUES_SQL} SELECT g.id, g.title, v.name AS venue_name, v.neighborhood AS venue_neighborhood
FROM gigs g LEFT JOIN venues v ON v.id = g.venue_id""")
def gigs_with_venues(spark, sf_dir):
    return listing.populate_venue(t.gigs(spark, sf_dir), t.venues(spark, sf_dir)).select(
        "id", "title", "venue_name", "venue_neighborhood")


@query(f"WITH {t.GIGS_SQL} SELECT id, title, {STAMP.format('date')} AS at FROM gigs ORDER BY date, id LIMIT 100")
def first_gigs(spark, sf_dir):
    return listing.top(t.gigs(spark, sf_dir)).select("id", "title", stamp("date").alias("at"))


_MONTH = "strftime(timezone('Europe/Athens', timezone('UTC', date)), '%Y-%m')"


@query(f"WITH {t.GIGS_SQL} SELECT {_MONTH} AS month_key, count(*) AS gigs, {STAMP.format('min(date)')} AS first_at FROM gigs GROUP BY 1")
def gigs_per_month(spark, sf_dir):
    return listing.month_counts(t.gigs(spark, sf_dir)).select("month_key", "gigs", stamp("first_date").alias("first_at"))


@query(f"""WITH {t.GIGS_SQL}, top AS (SELECT * FROM gigs WHERE date >= TIMESTAMP '{AS_OF}' ORDER BY date, id LIMIT 100)
SELECT id, {_MONTH} AS month_key, CAST(dense_rank() OVER (ORDER BY {_MONTH}) AS INTEGER) AS group_no,
  CAST(row_number() OVER (PARTITION BY {_MONTH} ORDER BY date, id) AS INTEGER) AS place FROM top""")
def listing_by_month(spark, sf_dir):
    rows = listing.top(listing.upcoming(t.gigs(spark, sf_dir), AS_OF))
    return listing.by_month(rows).select("id", "month_key", "group_no", "place")


@query(f"""WITH {t.GIGS_SQL}, {t.VENUES_SQL}, top AS (SELECT * FROM gigs WHERE date >= TIMESTAMP '{AS_OF}' ORDER BY date, id LIMIT 100),
z AS (SELECT t.*, v.name, v.website, timezone('Europe/Athens', timezone('UTC', date)) AS z FROM top t LEFT JOIN venues v ON v.id = t.venue_id)
SELECT id, title, strftime(z, '%Y-%m') AS month_key, strftime(z, '%B') AS month_label, strftime(z, '%a') AS weekday,
  day(z) || CASE WHEN day(z) IN (11, 12, 13) THEN 'th' WHEN day(z) % 10 = 1 THEN 'st' WHEN day(z) % 10 = 2 THEN 'nd'
                 WHEN day(z) % 10 = 3 THEN 'rd' ELSE 'th' END AS day,
  CASE WHEN nullif(url, '') IS NOT NULL THEN coalesce(price, 'Info') ELSE coalesce(price, '—') END AS price_label,
  name AS venue, nullif(website, '') AS venue_link FROM z""")
def upcoming_listing(spark, sf_dir):
    rows = listing.upcoming_listing(t.gigs(spark, sf_dir), t.venues(spark, sf_dir), AS_OF)
    return rows.select("id", "title", "month_key", "month_label", "weekday", "day", "price_label",
                       F.col("venue_link.name").alias("venue"), F.col("venue_link.website").alias("venue_link"))


@query(f"""WITH {t.GIGS_SQL} SELECT id, title FROM gigs WHERE lower(title) = 'act 7' AND manual IS DISTINCT FROM TRUE
  AND date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '1999-06-30 12:00:00' AND price = 'Free'""")
def filtered_gigs(spark, sf_dir):
    rows = t.gigs(spark, sf_dir)
    some = listing.list_filter(rows, {"title": ("eqi", "ACT 7"), "manual": ("ne", True), "price": ("eq", "Free")})
    return listing.list_filter(
        listing.list_filter(some, {"date": ("gte", "1996-01-01")}), {"date": ("lte", "1999-06-30 12:00:00")}
    ).select("id", "title")


@query(f"WITH {t.VENUES_SQL} SELECT id, name, neighborhood FROM venues WHERE id = 42")
def one_venue(spark, sf_dir):
    return listing.find_one(t.venues(spark, sf_dir), 42).select("id", "name", "neighborhood")


@query(f"""WITH {t.GIGS_SQL}, {t.VENUES_SQL}, f AS (SELECT * FROM gigs WHERE manual IS DISTINCT FROM TRUE),
p AS (SELECT * FROM f ORDER BY date, id LIMIT 25 OFFSET 50)
SELECT p.id, p.title, v.name AS venue_name, (SELECT count(*) FROM f) AS total FROM p LEFT JOIN venues v ON v.id = p.venue_id""")
def gig_page(spark, sf_dir):
    rows = listing.list_gigs(t.gigs(spark, sf_dir), t.venues(spark, sf_dir), {"manual": ("ne", True)}, number=3)
    return rows.select("id", "title", "venue_name", "total")


@query(f"""WITH {t.VENUES_SQL}, f AS (SELECT * FROM venues WHERE id % 5 > 0 AND neighborhood = 'BUILDING')
SELECT id, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY name DESC, id DESC LIMIT 20 OFFSET 40""")
def venue_page(spark, sf_dir):
    venues = t.venues(spark, sf_dir).where("id % 5 > 0")
    return listing.list_venues(venues, {"neighborhood": ("eqi", "building")}, number=3, size=20, descending=True).select("id", "name", "total")


# --- whole runs ------------------------------------------------------------

_SITE_OPTIONS = sync.SyncOptions(as_of="1996-01-01")


def _site_run(spark, sf_dir, stage=materialize):
    return sync.run_sync(t.site_hits(spark, sf_dir), t.site_pages(spark, sf_dir), t.stored_gigs(spark, sf_dir),
                         t.venues(spark, sf_dir), _SITE_OPTIONS, stage=stage)


@query(f"WITH {t.SITE_SQL}, {t.OUTCOMES_SQL} SELECT id, title, {STAMP.format('date')} AS at, price, url, venue_id FROM new_gigs")
def full_sync(spark, sf_dir):
    return _site_run(spark, sf_dir).reconciled.gigs.select(
        "id", "title", stamp("date").alias("at"), "price", "url", "venue_id")


@query(f"""WITH {t.SITE_SQL}, {t.OUTCOMES_SQL} SELECT (SELECT count(DISTINCT o_orderkey // 20) FROM orders) AS search_results,
  (SELECT count(DISTINCT o_orderkey // 20) + 2 FROM orders) AS filtered_urls, (SELECT count(*) FROM orders) AS scraped_urls,
  count(*) AS gigs_extracted, count(*) FILTER (outcome = 'created') AS gigs_created,
  count(*) FILTER (outcome = 'skipped') AS gigs_skipped, count(*) FILTER (outcome = 'error') AS errors FROM outcomes""")
def sync_counters(spark, sf_dir):
    return _site_run(spark, sf_dir).stats


@query(f"""WITH {t.SITE_SQL.replace("WHERE o.o_orderstatus = 'F'", "WHERE o.o_orderstatus = 'F' AND g.manual")}, {t.OUTCOMES_SQL}
SELECT title, {STAMP.format("date")} AS at, CAST(venue_id AS VARCHAR) AS venue, TRUE AS manual FROM stored
UNION ALL SELECT title, {STAMP.format("date")}, CAST(venue_id AS VARCHAR), FALSE FROM new_gigs""")
def clear_and_sync(spark, sf_dir):
    db = store.Store(spark, new_work_dir(spark, "store"))
    db.append(t.stored_gigs(spark, sf_dir), t.venues(spark, sf_dir))
    sync.sync_store(db, t.site_hits(spark, sf_dir), t.site_pages(spark, sf_dir), _SITE_OPTIONS, clear=True)
    return db.gigs().select("title", stamp("date").alias("at"), F.col("venue_id").cast("string").alias("venue"), "manual")


# Three days of responses, each read by one scheduled run. Every record has its own
# title, so the order of arrival inside a day does not matter.
@query(f"""WITH {t.PARSED_SQL} SELECT title, {STAMP.format("date")} AS at, price, url FROM parsed
WHERE title IS NOT NULL AND title <> '' AND length(title) <= 255 AND length(venue_name) <= 255
QUALIFY row_number() OVER (PARTITION BY lower(title), CAST(date AS DATE) ORDER BY batch % 3, batch) = 1""")
def incremental_sync(spark, sf_dir):
    work = new_work_dir(spark, "feed")
    texts = t.responses(spark, sf_dir)
    for day in range(3):
        texts.where(F.col("batch") % 3 == day).write.mode("append").json(f"{work}/in")
        start_incremental(spark, f"{work}/in", f"{work}/store", f"{work}/checkpoint").awaitTermination()
    return store.Store(spark, f"{work}/store").gigs().select("title", stamp("date").alias("at"), "price", "url")
