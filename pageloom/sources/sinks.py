"""Sinks. Each crawl becomes one folder whose parts, in name order, are its document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.sources.scratch import Scratch


def write_blocks(blocks: DataFrame, order: list[str], folder: str) -> None:
    """Write blocks of lines as text, one folder per crawl, overwriting what is there.

    Blocks are range-partitioned by their order, so a large crawl fills many tasks.
    """
    (
        blocks.repartitionByRange("crawl_id", *order)
        .sortWithinPartitions("crawl_id", *order)
        .select("crawl_id", F.array_join("lines", "\n").alias("value"))
        .write.mode("overwrite")
        .partitionBy("crawl_id")
        .text(folder)
    )


def write_plain_text(records: DataFrame, folder: str) -> None:
    """Write the texts of pages in the order of their URLs; failed pages have none.

    Records are written once before they are sorted, as sorting by ranges reads its input twice.
    """
    read = Scratch(records.sparkSession).write(records.where(F.col("text").isNotNull()).select("url", "text"), "texts")
    ordered = read.repartitionByRange("url").sortWithinPartitions("url")
    ordered.select(F.col("text").alias("value")).write.mode("overwrite").text(folder)


def write_table(rows: DataFrame, order: list[str], folder: str, fmt: str = "parquet") -> None:
    """Write report or node rows as a sorted table."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").format(fmt).save(folder)
