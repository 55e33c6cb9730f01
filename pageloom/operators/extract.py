"""Page records: cleaned text and title of each page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig, plain_config
from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.operators.parse import parse_pages
from pageloom.sources.snapshots import INVALID_URL


def heading(h1: Column, title_tag: Column) -> Column:
    """First heading, else title element; null where both are blank or missing."""
    blank = F.lit("")
    return F.coalesce(F.nullif(tx.strip(h1), blank), F.nullif(tx.strip(title_tag), blank))


def slug_title(base_url: Column) -> Column:
    """Title made of the last path segment of the crawl's base URL; may be empty."""
    return tx.title_case(F.replace(urls.last_segment(base_url), F.lit("-"), F.lit(" ")))


def title(heading_: Column, base_url: Column) -> Column:
    return F.coalesce(heading_, slug_title(base_url))


def page_records(pages: DataFrame, config: CrawlConfig, base_url: Column | None = None, parse: Callable = parse_pages) -> DataFrame:
    """``url, text, title, error`` and the other input columns of each page.

    Each page counts as its own base unless ``base_url`` names another. A page whose
    markup is rejected keeps its row, with the ``error`` and neither text nor title. ``parse``
    stands in for ``parse_pages``, as a parse store does.
    """
    parsed = parse(pages, config.with_(menu_selectors=(), priority_selectors=()))
    base = F.col("url") if base_url is None else base_url
    named = title(heading(F.col("h1"), F.col("title_tag")), base)
    return (
        parsed.withColumn("text", tx.clean_text(F.col("raw_text")))
        .withColumn("title", F.when(F.col("parse_error").isNull(), named))
        .withColumnRenamed("parse_error", "error")
        .drop("raw_text", "h1", "title_tag", "anchors")
    )


def plain_pages(pages: DataFrame) -> DataFrame:
    """Text alone, with only script and style dropped; invalid URLs keep their row, with an ``error``."""
    valid = urls.is_valid_url(F.col("url"))
    read = page_records(pages.withColumn("html", F.when(valid, F.col("html"))), plain_config())
    return read.drop("title").withColumn("error", F.when(~valid, INVALID_URL).otherwise(F.col("error")))
