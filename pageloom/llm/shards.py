"""Shards of nearly equal bytes: minimax contiguous partition of ordered atomic groups.

Rows of equal text are one group. Groups lie in the order of their text's MD5; the
atoms are the ``2**16`` runs of groups that share its first 16 bits, so their table has a
fixed bound however many groups there are, and no group is ever cut. An atom so large
that an equal share of what is left would not hold it gets a shard of its own. For the
others, a binary search finds the smallest capacity with which a greedy pass over the
atoms, in order, fills no more than the shards that are left; the atoms are cut within that
capacity, as evenly as the atoms behind a cut allow.
The search runs over one row that holds the atoms' sizes, in built-in functions.

Rows are numbered within their shard by atom, then identifier. An atom with more than
``split`` rows is numbered in several parts, each of which starts where its counts say.

Defined results: a null text counts as empty (16 bytes a row). Null identifiers come
first; rows that repeat get slots of their own. An empty table gives an empty result.
Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import written

OVERHEAD = 16  # bytes a row has besides its text


@dataclass(frozen=True)
class Cuts:
    own: list[int]  # atoms with a shard of their own, in shard order
    starts: list[int]  # first atoms of the other shards but the first


PEEL = """aggregate(big, struct(0 AS h, total AS rest, true AS more), (s, x) ->
  IF(s.more AND s.h < {n} - 1 AND x.bytes * ({n} - s.h) > s.rest, struct(s.h + 1 AS h, s.rest - x.bytes AS rest, true AS more), struct(s.h AS h, s.rest AS rest, false AS more)))"""
FILLED = "aggregate(atoms, struct(1 AS n, 0L AS fill), (s, x) -> IF(s.fill + x.bytes > {c}, struct(s.n + 1 AS n, x.bytes AS fill), struct(s.n AS n, s.fill + x.bytes AS fill))).n"
SEARCH = """aggregate(sequence(1, 63), struct({low}L AS low, {high}L AS high), (r, i) -> IF(r.low < r.high,
  IF({fits} <= {k}, struct(r.low AS low, (r.low + r.high) DIV 2 AS high), struct((r.low + r.high) DIV 2 + 1 AS low, r.high AS high)), r)).low"""
REST = FILLED.format(c="{capacity}L").replace("aggregate(atoms,", "aggregate(slice(atoms, s.i, size(atoms)),")
# A shard ends before the atom that would overfill it, or, if the atoms behind still fit into the shards behind, where
# it is closest to an equal share of what was left when it began.
CUT = """aggregate(atoms, struct(1 AS i, 0L AS fill, {rest}L AS left, {k} AS shards, CAST(array() AS array<int>) AS cuts), (s, x) -> IF(
  s.fill > 0 AND s.shards > 1 AND (s.fill + x.bytes > {capacity}L OR (2 * s.fill + x.bytes) * s.shards > 2 * s.left AND {behind} <= s.shards - 1),
  struct(s.i + 1 AS i, x.bytes AS fill, s.left - s.fill AS left, s.shards - 1 AS shards, concat(s.cuts, array(x.atom)) AS cuts),
  struct(s.i + 1 AS i, s.fill + x.bytes AS fill, s.left AS left, s.shards AS shards, s.cuts AS cuts))).cuts"""


def cuts(atoms: DataFrame, shards: int) -> Cuts:
    """Where to cut a table (atom int, bytes long) of distinct atoms."""
    pairs = F.collect_list(F.struct("bytes", "atom"))
    row = atoms.agg(F.sort_array(pairs, asc=False).alias("big"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    row = written(row.withColumn("peel", F.expr(PEEL.format(n=shards))), "atom_row")
    row = row.select(F.expr("slice(big, 1, peel.h)").alias("own"), F.expr("array_sort(transform(slice(big, peel.h + 1, size(big)), x -> struct(x.atom AS atom, x.bytes AS bytes)))").alias("atoms"), F.expr(f"{shards} - peel.h").alias("k"), F.col("peel.rest").alias("rest"))
    # Written after each step: an expression that another one repeats for every atom must not be computed anew there.
    row = written(row, "atom_row")
    limits = row.select("k", "rest", F.expr("CAST(ceil(rest / k) AS bigint)").alias("share"), F.expr("coalesce(array_max(transform(atoms, x -> x.bytes)), 0L)").alias("most")).first()
    bounds = dict(low=max(limits.share, limits.most), high=limits.share + limits.most, k=limits.k)
    capacity = row.select(F.expr(SEARCH.format(fits=FILLED.format(c="(r.low + r.high) DIV 2"), **bounds)).alias("c")).first().c
    found = row.select(F.expr("transform(own, x -> x.atom)").alias("own"), F.expr(CUT.format(capacity=capacity, rest=limits.rest, k=limits.k, behind=REST.format(capacity=capacity))).alias("cuts")).first()
    return Cuts(list(found.own), list(found.cuts))


def shard_by_bytes(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", split: int = 1_000_000) -> DataFrame:
    """``key``, size, text_crc32, atom, shard and slot of every row."""
    value = F.coalesce(F.col(text), F.lit(""))
    atom = F.conv(F.substring(F.md5(value), 1, 4), 16, 10).cast("int")
    rows = docs.select(key, (F.octet_length(value) + F.lit(OVERHEAD).cast("bigint")).alias("size"), F.crc32(value).alias("text_crc32"), atom.alias("atom"))
    rows = written(rows.withColumn("row_", F.monotonically_increasing_id()), "shard_rows")
    atoms = written(rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "atoms")
    at = cuts(atoms, shards)
    own, starts = (F.array(*map(F.lit, x)) if x else F.array().cast("array<int>") for x in (at.own, at.starts))
    place = F.array_position(own, F.col("atom"))
    shard = F.when(place > 0, place - 1).otherwise(len(at.own) + F.size(F.filter(starts, lambda c: c <= F.col("atom"))))
    parts = F.ceil(F.col("rows") / split)
    placed = rows.join(atoms.select("atom", shard.cast("int").alias("shard"), parts.alias("parts")), "atom")
    placed = placed.withColumn("part", F.pmod(F.xxhash64(key, "row_"), F.col("parts"))).drop("parts")
    counts = placed.groupBy("shard", "atom", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("atom", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts_at = counts.select("atom", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("atom", "part").orderBy(key, "row_")
    numbered = placed.withColumn("nr", F.row_number().over(within)).join(starts_at, ["atom", "part"])
    return numbered.select(key, "size", "text_crc32", "atom", "shard", (F.col("start") + F.col("nr") - 1).alias("slot"))
