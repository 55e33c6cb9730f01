"""Page extraction over a stream of snapshots.

Extraction and link selection look at one page at a time, so they take a streaming
DataFrame as it is; the traversal needs the whole link table and stays a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.config import CrawlConfig
from pageloom.operators.extract import page_records
from pageloom.operators.links import link_rows, with_page_links
from pageloom.operators.parse import parse_pages
from pageloom.sources.snapshots import PAGES_SCHEMA


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New snapshot files of a folder as they arrive."""
    return spark.readStream.schema(PAGES_SCHEMA).parquet(folder)


def record_stream(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    return page_records(pages, config)


def link_stream(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    return link_rows(with_page_links(parse_pages(pages, config), config))
