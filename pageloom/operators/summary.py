"""Counts over a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.sources.snapshots import is_retryable_error


def crawl_summary(visited: DataFrame) -> DataFrame:
    """Visited and scraped pages per crawl."""
    return visited.groupBy("crawl_id").agg(
        F.count("*").alias("visited"), F.count_if("scraped").alias("scraped")
    )


def level_progress(visited: DataFrame) -> DataFrame:
    """Visited and scraped pages per level, with the visited pages up to that level."""
    levels = visited.groupBy("crawl_id", "level").agg(
        F.count("*").alias("visited"), F.count_if("scraped").alias("scraped")
    )
    # A crawl has one row per level here, so the window never sees more than that.
    so_far = Window.partitionBy("crawl_id").orderBy("level")
    return levels.withColumn("visited_so_far", F.sum("visited").over(so_far))


def failure_counts(visited: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Failed pages per crawl and error, refused seeds included."""
    failed = visited.where(F.col("error").isNotNull()).select("crawl_id", "error")
    if rejected is not None:
        failed = failed.unionByName(rejected.select("crawl_id", "error"))
    return failed.groupBy("crawl_id", "error").agg(F.count("*").alias("pages"))


def retryable_failures(failures: DataFrame) -> DataFrame:
    """``failure_counts`` with ``retryable``: whether a later request may succeed."""
    return failures.withColumn("retryable", is_retryable_error(F.col("error")))
