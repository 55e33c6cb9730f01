"""What pages were parsed to, kept across runs by the digest of their markup.

A page's record depends on its markup and on a few settings (selectors, dropped elements, blanks).
So records are stored under the SHA-256 of the markup, in a folder for each hash of those settings.
``parse`` stands in for ``parse_pages``: it looks up the digests of its pages, parses each unseen one
once, however many pages share it, adds the new records and joins all of them back.

Records are added as a folder of their own that a manifest lists after it is complete, under a new
name by one rename; a run that stops adds nothing. Two runs that add at the same time may parse
a page twice, which a later look-up reduces; the records are the same.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.config import CrawlConfig
from pageloom.operators.parse import PARSED_FIELDS, parse_pages
from pageloom.sources.packed import manifests, newest, opened

FORMAT = 1  # of the records; a change of what the reader yields takes a new number
DIGEST = "markup_digest"
RECORDS = T.StructType([T.StructField(DIGEST, T.BinaryType()), *PARSED_FIELDS])


def settings_hash(config: CrawlConfig) -> str:
    """Hash of the settings that a page's record depends on."""
    own = [FORMAT, config.selectors, sorted(config.drop_tags), config.collapse_blanks]
    return hashlib.sha256(json.dumps(own).encode()).hexdigest()[:24]


class ParseStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.parsed = 0  # pages the last call had to parse

    def records(self, config: CrawlConfig) -> DataFrame:
        """Stored records, one a digest."""
        folder = f"{self.folder}/{settings_hash(config)}"
        _, runs = newest(*opened(folder))
        if not runs:
            return self.spark.createDataFrame([], RECORDS)
        rows = self.spark.read.schema(RECORDS).parquet(*[f"{folder}/{run['run']}" for run in runs])
        # A run's own digests are distinct; only those that two runs added at once need reducing.
        return rows if all(run.get("alone") for run in runs) else rows.dropDuplicates([DIGEST])

    def _add(self, records: DataFrame, config: CrawlConfig, before: int) -> None:
        """Write the new records and publish a manifest that lists them."""
        folder, run = f"{self.folder}/{settings_hash(config)}", f"run-{uuid.uuid4().hex[:16]}"
        records.write.parquet(f"{folder}/{run}")
        self.parsed = self.spark.read.schema(RECORDS).parquet(f"{folder}/{run}").count()  # from the files' footers
        store, root = opened(folder)
        if not self.parsed:
            store.delete_dir(f"{root}/{run}")
            return
        number, runs = newest(store, root)
        text = json.dumps({"runs": [*runs, {"run": run, "rows": self.parsed, "alone": number == before}]}, indent=1).encode()
        with store.open_output_stream(f"{root}/{run}.new") as out:
            out.write(text)
        store.move(f"{root}/{run}.new", f"{root}/manifest-{number + 1}.json")
        for old, path in manifests(store, root):
            if old <= number:
                store.delete_file(path)

    def parse(self, pages: DataFrame, config: CrawlConfig) -> DataFrame:
        """``parse_pages(pages, config)`` by way of the store. Null markup gives nulls and is not stored."""
        before, _ = newest(*opened(f"{self.folder}/{settings_hash(config)}"))
        digest = F.unhex(F.sha2("html", 256)).alias(DIGEST)
        known = self.records(config).select(DIGEST)
        # Copies are reduced before their markup is shuffled.
        unseen = pages.where(F.col("html").isNotNull()).select(digest, "html").join(known, DIGEST, "left_anti")
        once = unseen.groupBy(DIGEST).agg(F.first("html").alias("html"))
        self._add(parse_pages(once, config).select(*RECORDS.names), config, before)
        marked = pages.withColumn(DIGEST, digest).drop("html")
        return marked.join(self.records(config), DIGEST, "left").drop(DIGEST)
