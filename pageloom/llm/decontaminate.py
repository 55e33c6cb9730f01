"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased sequences of words (letters and digits). An item with q distinct
shingles is contained in a document that holds at least ``threshold`` of them, so such a
document misses at most q - ceil(threshold * q). The sketch of an item is its MinHash
bottom-k, the k shingles with the smallest hashes, with k one more than that number of
misses: every document that contains the item holds at least one shingle of its sketch.
Items are partitioned by size (powers of two). Each partition has its own largest sketch
hash, which bounds the hashes that a document has to look up in it, and its own map; a
document with fewer shingles than the partition's least item needs skips it. So the search
loses no link, unlike banded MinHash, whose miss rate grows with the length of the
document. Candidates are verified by counting the item's shingles that the document holds,
as strings.

Documents are read once. What they need of the items are bit maps, one of each partition's
sketches and one of all shingles, of about ``spread`` bits a shingle, up to ``2**most_bits``
each; false hits of the maps vanish in the joins by hash and by shingle.

Defined results: null and empty texts are neither documents nor items that match. An
item of fewer than ``shingle`` words is one shingle of all its words. Repeated documents
each have their rows; repeated items count once per item identifier. Other columns are
left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import free_name, slices, written

TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ContainmentSettings:
    shingle: int = 5
    threshold: float = 0.8
    spread: int = 64  # bits of a map for each shingle in it
    most_bits: int = 30  # 128 MB


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def shingles(words: list[str], size: int) -> list[str]:
    """Distinct shingles, in the order of their first place."""
    if not words:
        return []
    return list(dict.fromkeys(map(" ".join, zip(*(words[k:] for k in range(min(size, len(words))))))))


def hash_of(shingle: str) -> int:
    return xxhash.xxh64_intdigest(shingle.encode("utf-8", "surrogatepass")) >> 1  # fits a signed long


def item_shingles(items: DataFrame, key: str, text: str, s: ContainmentSettings) -> DataFrame:
    """(item, shingle, hash, size, words, needed, part, sketched) of every distinct shingle of every item."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text_"))
    kind = dict(rows.dtypes)["item"]

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("at", "shingle", "hash", "size", "words", "needed", "part", "sketched")}
            for at, value in enumerate(batch.column("text_")):
                words = tokens(value.as_py())
                found = shingles(words, s.shingle)
                needed = math.ceil(s.threshold * len(found) - 1e-9)
                order = sorted((hash_of(x), x) for x in found)
                for rank, (h, x) in enumerate(order):
                    line = (at, x, h, len(found), min(s.shingle, len(words)), needed, len(found).bit_length(), rank <= len(found) - needed)
                    for column, v in zip(out.values(), line):
                        column.append(v)
            own = batch.column("item").take(pa.array(out.pop("at"), pa.int64()))
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            made = [pa.array(v, t) for v, t in zip(out.values(), types)]
            yield pa.RecordBatch.from_arrays([own, *made], names=["item", *out])

    schema = f"item {kind}, shingle string, hash bigint, size int, words int, needed int, part int, sketched boolean"
    return rows.mapInArrow(run, schema).dropDuplicates(["item", "shingle"])


@dataclass(frozen=True)
class BitMap:
    """Which hashes, by their lowest bits, may be there."""

    bits: int
    packed: np.ndarray

    @classmethod
    def of(cls, hashes: DataFrame, n: int, s: ContainmentSettings) -> BitMap:
        """At most 2**bits positions reach the driver, however many hashes there are."""
        bits = min(s.most_bits, max(10, (n * s.spread - 1).bit_length()))
        at = hashes.select(F.expr(f"hash & {(1 << bits) - 1}").cast("int").alias("at")).distinct().toArrow().column("at")
        map_ = np.zeros(1 << bits, dtype=bool)
        map_[at.to_numpy()] = True
        return cls(bits, np.packbits(map_, bitorder="little"))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (1 << self.bits) - 1
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


@dataclass(frozen=True)
class Partition:
    """Items of about one size: their number, the largest hash of their sketches, the fewest shingles
    that one of them needs, and the map of their sketches."""

    part: int
    bound: int
    least: int
    sketches: BitMap


def partitions(sketch: DataFrame, s: ContainmentSettings) -> list[Partition]:
    """One for each power of two among the items' sizes, so there are few."""
    found = sketch.groupBy("part").agg(F.max("hash").alias("bound"), F.min("needed").alias("least"), F.count("*").alias("n")).orderBy("part").collect()
    return [Partition(r.part, r.bound, r.least, BitMap.of(sketch.where(F.col("part") == r.part), r.n, s)) for r in found]


def lookups(hashes: np.ndarray, n: int, parts: list[Partition]) -> list[int]:
    """Hashes of a document with ``n`` distinct shingles that may be in some item's sketch."""
    hits: set[int] = set()
    for p in parts:
        if n >= p.least:
            low = hashes[hashes <= p.bound]
            hits.update(low[p.sketches.holds(low)].tolist())
    return sorted(hits)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", settings: ContainmentSettings = ContainmentSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, ``item_key``, n_shingles (of the item), n_shared and containment of every
    document and item that it contains."""
    s = settings
    pieces = written(item_shingles(items, item_key, item_text, s), "item_shingles")
    lengths = sorted(r[0] for r in pieces.select("words").distinct().collect())  # 1 to the shingle length
    sketch = pieces.where("sketched")
    context = docs.sparkSession.sparkContext
    maps = context.broadcast((partitions(sketch, s), BitMap.of(pieces, pieces.count(), s)))

    def look(value):
        words = tokens(value)
        found = []
        for n in lengths:
            if len(words) >= n:
                found += shingles(words, n)
        parts, every = maps.value
        hashes = np.fromiter(map(hash_of, found), dtype=np.int64, count=len(found))
        distinct = len(set(found))
        hits = lookups(hashes, distinct, parts)
        if not hits:
            return None
        return distinct, hits, [found[i] for i in np.flatnonzero(every.holds(hashes))]

    rows = docs.select(F.col(key).alias("key_"), *keep, F.col(text).alias("text_"))
    kept = ("key_", *keep)

    def run(batches):
        for batch in slices(batches):
            seen = [look(t.as_py()) for t in batch.column("text_")]
            at = [i for i, x in enumerate(seen) if x]
            own = [batch.column(n).take(pa.array(at, pa.int64())) for n in kept]
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            made = [pa.array([seen[i][k] for i in at], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(own + made, names=[*kept, "n", "hits", "shared"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text_")
    read = rows.mapInArrow(run, f"{fields}, n bigint, hits array<bigint>, shared array<string>")
    read = written(read.withColumn("row_", F.monotonically_increasing_id()), "sketch_hits")
    hits = read.select("row_", "n", F.explode("hits").alias("hash"))
    candidates = hits.join(sketch.select("hash", "item", "needed"), "hash").where("n >= needed").select("row_", "item").distinct()
    shared = read.select("row_", F.explode("shared").alias("shingle"))
    # From candidates to their items' shingles to those the document holds: no pair without a common sketch hash is made.
    asked = candidates.join(pieces.select("item", "shingle", "size", "needed"), "item")
    both = asked.join(shared, ["row_", "shingle"])
    exact = both.groupBy("row_", "item").agg(F.count("*").alias("n_shared"), F.first("size").alias("n_shingles"), F.first("needed").alias("needed"))
    exact = exact.where("n_shared >= needed")
    named = read.select("row_", F.col("key_").alias(key), *keep).join(exact, "row_")
    return named.select(key, *keep, F.col("item").alias(item_key), F.col("n_shingles").cast("bigint").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", settings: ContainmentSettings = ContainmentSettings()) -> DataFrame:
    """The rows of ``docs`` whose text contains no item."""
    mark = free_name(docs, "text_hash_")
    hashed = docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    found = contaminated(hashed, items, key, text, item_key, item_text, settings, (mark,))
    found = written(found.select(mark).distinct(), "contaminated")
    return hashed.join(found, mark, "left_anti").select(*docs.columns)
