"""Crawled pages as the table the later steps read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill import schemas
from playbill.functions.base import compute_once
from playbill.functions.html import page_links, page_text


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Already scraped pages in the full row shape; failures have success=false."""
    return spark.read.schema(schemas.SCRAPED_PAGE).parquet(path)


def scrape_rows(pages: DataFrame) -> DataFrame:
    """Raw pages (url, html[, error]) as scraped rows.

    A page without markup is a failed one. Text and links come out of the same
    scan, inside the row.
    """
    ok = F.coalesce(F.col("html") != "", F.lit(False))
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    extra = [c for c in pages.columns if c not in ("url", "html", "error")]
    read = compute_once(pages, text=F.when(ok, page_text(F.col("html"))))
    return read.select(
        *extra, "url", "text",
        F.when(ok, F.col("html")).alias("raw_html"),
        ok.alias("success"),
        F.when(~ok, F.coalesce(error, F.lit("no content"))).alias("error"),
        F.when(ok, page_links(F.col("html"), F.col("url"))).alias("links"),
    )


def successful(pages: DataFrame) -> DataFrame:
    return pages.where("success")


def has_text() -> Column:
    return F.coalesce(F.length("text") > 0, F.lit(False))


def with_text(pages: DataFrame) -> DataFrame:
    """Successful pages with non-empty text; pages without text never reach the
    raw-page fallback."""
    return pages.where(F.col("success") & has_text())


def scrape_counts(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count_if("success").alias("successful"),
                     F.count_if(~F.col("success")).alias("failed"),
                     F.count(F.lit(1)).alias("total"))
