"""Page snapshots and seeds as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.config import RETRYABLE_STATUS, CrawlConfig
from pageloom.functions import urls

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
SEEDS_SCHEMA = T.StructType(
    [T.StructField("crawl_id", T.StringType()), T.StructField("url", T.StringType())]
)
INVALID_URL = "Invalid URL provided"
MISSING_PAGE = "Failed to fetch URL: no page stored"
LAST_PAGE_ID = (1 << 63) - 1


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Repartition a scan that has fewer than ``partitions``; None stands for the number of cores.

    A large scan has many splits already and stays as it is, so no page is shuffled
    at scale; a small file would otherwise be parsed by one task.
    """
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(partitions) if df.rdd.getNumPartitions() < partitions else df


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``page_id, url, html`` of a snapshot; ``status`` and ``timed_out`` too where present.

    It has at least ``partitions`` partitions; None stands for the number of cores.
    """
    stored = spark.read.parquet(path)
    optional = [name for name in ("status", "timed_out") if name in stored.columns]
    return spread(stored.select("page_id", "url", "html", *optional), partitions)


def http_error(status: Column) -> Column:
    return F.concat(F.lit("Failed to fetch URL (HTTP "), status.cast("string"), F.lit(")"))


def fetch_error(pages: DataFrame, config: CrawlConfig) -> Column:
    """Why a stored page counts as not fetched; null where it was fetched."""
    error = F.lit(None).cast("string")
    if "status" in pages.columns:
        error = F.when(F.col("status") >= 400, http_error(F.col("status"))).otherwise(error)
    if "timed_out" in pages.columns:
        late = F.lit(f"Request timed out after {config.timeout} seconds")
        error = F.when(F.col("timed_out"), late).otherwise(error)
    return error


def copy_order(pages: DataFrame) -> Column:
    """Rank of a stored copy among those of the same URL; the lowest one counts.

    Only copies that agree in all that is read of them tie.
    """
    first = F.col("page_id") if "page_id" in pages.columns else F.lit(None).cast("bigint")
    state = [F.col(name) for name in ("status", "timed_out") if name in pages.columns]
    return F.struct(F.coalesce(first, F.lit(LAST_PAGE_ID)), *state, F.sha2("html", 256))


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE_STATUS)


def is_retryable_error(error: Column) -> Column:
    """Whether a failure is one of those a later request may not meet; false where there is none."""
    texts = [http_error(F.lit(status)) for status in RETRYABLE_STATUS]
    return F.coalesce(error.isin(*texts), F.lit(False))


def page_lookup(requests: DataFrame, pages: DataFrame, config: CrawlConfig) -> DataFrame:
    """Requested URLs with ``scraped``, ``error`` and ``retryable``; a missing page is a failed fetch."""
    first_copy = F.min_by(fetch_error(pages, config), copy_order(pages))
    stored = pages.groupBy("url").agg(first_copy.alias("fetch_error")).withColumn("stored", F.lit(True))
    hit = F.coalesce(F.col("stored"), F.lit(False))
    return (
        requests.join(stored, "url", "left")
        .withColumn(
            "error",
            F.when(~urls.is_valid_url(F.col("url")), INVALID_URL)
            .when(~hit, MISSING_PAGE)
            .otherwise(F.col("fetch_error")),
        )
        .withColumns({"scraped": F.col("error").isNull(), "retryable": is_retryable_error(F.col("error"))})
        .drop("stored", "fetch_error")
    )


