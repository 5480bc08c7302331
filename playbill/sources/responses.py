"""JSON documents that outside services return, read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import schemas
from playbill.functions.base import compute_once

_STRICT = {"allowSingleQuotes": "false"}


def _document(text: Column, ddl: str) -> Column:
    """Parsed JSON object; null when the text is not exactly one object."""
    return F.when(text.rlike(r"\}\s*\z"), F.from_json(text, ddl, _STRICT))


def parse_search_responses(df: DataFrame, column: str, query_idx: str) -> DataFrame:
    """Search hits of response texts; a response without results gives no rows."""
    doc = F.from_json(F.col(column), schemas.SEARCH_RESPONSE, _STRICT)
    hits = df.select(F.col(query_idx).alias("query_idx"), F.posexplode(doc["web"]["results"]).alias("rank", "hit"))
    return hits.select("query_idx", "rank", "hit.url", "hit.title", "hit.description")


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Search hits from response files, one JSON document per file or line, with a
    `query_idx` field next to `web`."""
    schema = f"query_idx int, {schemas.SEARCH_RESPONSE.fields[0].simpleString().replace(':', ' ', 1)}"
    docs = spark.read.schema(schema).json(path)
    hits = docs.select("query_idx", F.posexplode("web.results").alias("rank", "hit"))
    return hits.select("query_idx", "rank", "hit.url", "hit.title", "hit.description")


def parse_gig_responses(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """Event records of model responses, with the `keep` columns and the record's
    position `pos`.

    Bad text or a missing list gives no rows. Records are parsed one by one, so a
    malformed record drops out alone.
    """
    doc = _document(F.col(column), "gigs array<string>")
    items = df.select(*keep, F.posexplode(doc["gigs"]).alias("pos", "item"))
    parsed = compute_once(items, g=F.from_json("item", schemas.MODEL_GIG, _STRICT))
    return parsed.where(F.col("g").isNotNull()).select(*keep, "pos", "g.*")


def parse_url_list(df: DataFrame, column: str, field: str, *keep: str) -> DataFrame:
    """Addresses of a selection response, e.g. `promising_urls`, in order."""
    doc = _document(F.col(column), f"`{field}` array<string>")
    return df.select(*keep, F.posexplode(doc[field]).alias("pos", "url")).where(F.col("url").isNotNull())
