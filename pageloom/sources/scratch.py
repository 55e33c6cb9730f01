"""Written tables that cut lineage between the rounds of a crawl.

They live in the folder that ``spark.checkpoint.dir`` names, which every executor
shares, so a lost executor costs no more than its own tasks. Unlike a checkpoint, a
written table is computed once, keeps column pruning, and tells the optimizer its true
size, which is what decides whether a join may broadcast it. That is the size of its
packed files; a table that would take many times more in memory is kept out of broadcasts.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

BUCKET_BYTES = 256 * 1024 * 1024
UNKNOWN_BYTES = 1 << 60
# Of a whole table, unpacked. A hash table cannot spill, and adaptive execution may put all partitions into one task.
HASHED_BYTES = 64 * 1024 * 1024
# Unpacked rows that are broadcast take at most this many times what Spark's threshold says.
BROADCAST_GROWTH = 4
# Rows are taken to unpack to at most this many times their files; smaller files are not read to find out.
MOST_PACKED = 64


def shared_folder(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pageloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Names and writes the intermediate tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.run = uuid.uuid4().hex
        self.folder = f"{shared_folder(spark)}/pageloom-{self.run}"
        self.count = 0
        self.tables: list[str] = []

    def _next(self, label: str) -> str:
        self.count += 1
        return f"{label}_{self.count}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return it as a scan."""
        name = self._next(label)
        path = f"{self.folder}/{name}"
        if not self._finished(name):
            df.write.parquet(path)
            self._publish(name)
        return unpacked(self.spark.read.schema(df.schema).parquet(path))

    def write_bucketed(self, df: DataFrame, label: str, key: str | list[str], buckets: int, options: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` bucketed by ``key``, so that joins on it do not shuffle it again.

        ``df`` should come out of a shuffle on ``key``. A bucket then is one file where
        ``buckets`` is a multiple of the shuffle partitions; for other numbers the rows are
        shuffled into exactly ``buckets`` tasks first.
        """
        keys = [key] if isinstance(key, str) else key
        name = self._next(label)
        path, table = f"{self.folder}/{name}", f"pageloom_{self.run}_{name}"
        if self._finished(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            by = ", ".join(f"`{k}`" for k in keys)
            self.spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({by}) INTO {self._buckets(name)} BUCKETS LOCATION '{path}'")
        else:
            if buckets % int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.repartition(buckets, *keys)
            writer = df.write.format("parquet").options(**(options or {})).bucketBy(buckets, *keys)
            writer.option("path", path).saveAsTable(table)
            self._publish(name, buckets)
        self.tables.append(table)
        return self.spark.table(table).select(*df.columns)

    def _finished(self, name: str) -> bool:
        """Whether an earlier run has written this table; a journal knows."""
        return False

    def _publish(self, name: str, buckets: int | None = None) -> None:
        """Called once a table is complete."""

    def _buckets(self, name: str) -> int:
        raise KeyError(name)

    def release(self) -> None:
        """Take the bucketed tables out of the catalog; their files stay readable."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")

    def write_ordered(self, df: DataFrame, label: str, keys: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` in the order of unique keys, with ``ord``, a long that rises with them.

        Keys in ``drop`` serve for the order only and are not written.
        """
        sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*drop)
        return self.write(sorted_.withColumn("ord", F.monotonically_increasing_id()), label)


def bucket_count(spark: SparkSession, size: int | None) -> int:
    """The multiple of the shuffle partitions that gives buckets of at most about
    ``BUCKET_BYTES``. Unknown sizes get one bucket per shuffle partition."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = 1 if size is None else math.ceil(size / BUCKET_BYTES)
    return partitions * max(1, math.ceil(needed / partitions))


def input_bytes(df: DataFrame) -> int | None:
    """Optimizer's size of a scan; None where it has no idea."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < UNKNOWN_BYTES else None


def broadcast_threshold(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _width(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row in memory."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x: _width(x, kind.elementType).cast("bigint"))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def held_bytes(df: DataFrame) -> int:
    """About what all rows take in memory. Reads them."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16))
    return df.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def unpacked(df: DataFrame) -> DataFrame:
    """``df``, a scan, kept out of joins by broadcast where only the size of its packed files allows them.

    Such a join collects the rows on the driver. A sorted join in its place can spill.
    """
    size, threshold = input_bytes(df), broadcast_threshold(df.sparkSession)
    if size is None or not threshold / MOST_PACKED < size <= threshold:
        return df
    return df.hint("merge") if held_bytes(df) > BROADCAST_GROWTH * threshold else df


def hashed(df: DataFrame) -> DataFrame:
    """``df``, a scan with few rows a key, as the hash side of a shuffled join where it fits: the other side is
    not sorted then.

    Where Spark would broadcast it and its unpacked rows are few enough, it is left to Spark; where its rows do not fit
    into one task, it is sorted, since a hash table cannot spill.
    """
    size, threshold = input_bytes(df), broadcast_threshold(df.sparkSession)
    if size is None or size > max(threshold, HASHED_BYTES):
        return df
    held = held_bytes(df)
    if size <= threshold and held <= BROADCAST_GROWTH * threshold:
        return df
    if held <= HASHED_BYTES:
        return df.hint("shuffle_hash")
    return df.hint("merge") if size <= threshold else df
