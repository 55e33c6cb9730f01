"""Row numbers in a total order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.sources.scratch import Scratch

# monotonically_increasing_id keeps the partition number above this bit.
PARTITION_SHIFT = 33


def with_ordinal(df: DataFrame, group: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Add ``name``: 1, 2, … within each group, in the given order.

    Nulls of a group column form one group. Rows are range-partitioned and sorted once and written. Each partition then counts
    its own rows per group, and a running sum over those counts (at most one row per
    group and partition) gives every partition its start. One huge group spreads over
    as many partitions as it fills.
    """
    placed = scratch.write_ordered(df, name, group + order)
    placed = placed.withColumn("part", F.shiftright("ord", PARTITION_SHIFT))
    counts = placed.groupBy(*group, "part").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    keys = [*group, "part"]
    starts = counts.select(*[F.col(key).alias(f"{key}_") for key in keys], "first", start)
    numbered = placed.join(starts, [placed[key].eqNullSafe(starts[f"{key}_"]) for key in keys])
    ordinal = F.col("start") + F.col("ord") - F.col("first") + 1
    return numbered.select(*df.columns, ordinal.alias(name))
