"""SimHash near-duplicates by anchor points.

Fingerprints are 64-bit majorities over the hashes of word shingles. Two fingerprints
are linked if at most ``distance`` bits differ. The 64 bits are cut into blocks with
limits t that add up so that linked fingerprints differ by at most t bits in at least one
block (sum of t + 1 over the blocks exceeds ``distance``). Within a block a covering code
of radius R gives the anchors: Hamming's (15, 11) code on its first 15 bits (R = 1), or
every value where t = 0 (R = 0). A fingerprint is at home at its nearest anchor, within R,
and is replicated to all anchors within R + t, so the home anchor of one of two linked
fingerprints holds the other as well. At each anchor those at home are compared with all.

Equal fingerprints become one row before anything is replicated. An anchor that holds
more than ``split`` fingerprints is dealt out over a grid of tasks (chunks of those at
home times chunks of all), which compares the same pairs. Not all links within a group
are returned, but a forest that connects what they connect.

Defined results: null and empty texts have fingerprint zero, linked like any other.
Repeated rows share their fingerprint. Null identifiers take part, but are no component's
name unless it has no other. An empty table gives an empty result. Other columns are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_text, byte_words, free_name, written
from pageloom.llm.components import components

CODE_BITS, CODE_CHECKS = 15, 4
SMALL = 256  # pairs of an anchor that are compared together with those of other anchors
PAIRS = 1 << 20  # pairs in memory at once


@dataclass(frozen=True)
class SimHashSettings:
    shingle: int = 4
    distance: int = 4
    seed: int = 42
    blocks: tuple[tuple[int, int], ...] = ((21, 1), (21, 1), (22, 0))  # bits, limit t
    split: int = 20_000

    def __post_init__(self):
        if sum(bits for bits, _ in self.blocks) != 64 or sum(t + 1 for _, t in self.blocks) <= self.distance:
            raise ValueError("blocks must hold 64 bits, and their limits plus one exceed the distance")
        if any(t and bits < CODE_BITS for bits, t in self.blocks):
            raise ValueError(f"a block with a limit over 0 needs {CODE_BITS} bits")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint; a bit is set if over half of the shingles' XXH64 have it."""
    words = byte_words(text)
    words = b" ".join(words).lower().split(b" ") if words else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        part = words[start : start + (1 << 16) + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in joined], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """``keep`` and fp, the fingerprint as a signed long."""
    kept = docs.select(*keep, F.col(text).alias("text_"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes if n != "text_"), "fp bigint"])

    def signed(value):
        fp = fingerprint(value, settings.shingle, settings.seed)
        return (fp - (1 << 64) if fp >> 63 else fp,)

    def run(batches):
        for batch in batches:
            own = pa.schema([*(batch.schema.field(n) for n in keep), pa.field("fp", pa.int64())])
            yield from by_text(iter([batch]), "text_", signed, own, keep)

    return kept.mapInArrow(run, schema)


class Code:
    """Anchors of one block: the nearest one, and all within R + t."""

    def __init__(self, bits: int, limit: int):
        self.bits, self.limit = bits, limit
        if limit:
            flips, layer = [0], [(0, 0)]
            for _ in range(limit + 1):
                layer = [(x | 1 << b, b + 1) for x, first in layer for b in range(first, bits)]
                flips += [x for x, _ in layer]
            flips = np.array(flips, dtype=np.uint64)
            checks = self.syndrome(flips)
            self.flips = [flips[checks == s] for s in range(1 << CODE_CHECKS)]

    @staticmethod
    def syndrome(values: np.ndarray) -> np.ndarray:
        """Exclusive-or of the numbers 1 to 15 of the set bits among the first 15."""
        out = np.zeros(len(values), dtype=np.uint64)
        for b in range(CODE_BITS):
            out ^= (values >> np.uint64(b) & np.uint64(1)) * np.uint64(b + 1)
        return out

    def anchors(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays: index into ``values``, anchor, and whether it is the value's home."""
        if not self.limit:
            yield np.arange(len(values)), values, np.ones(len(values), dtype=bool)
            return
        checks = self.syndrome(values)
        for s, flips in enumerate(self.flips):
            at = np.flatnonzero(checks == s)
            home = np.uint64(1 << s - 1 if s else 0)
            own = values[at]
            yield np.repeat(at, len(flips)), (own[:, None] ^ flips[None, :]).ravel(), np.tile(flips == home, len(at))


def at_anchors(prints: DataFrame, settings: SimHashSettings) -> DataFrame:
    """(block, anchor, home, fp) of every fingerprint and anchor within reach."""

    def run(batches):
        codes = [Code(bits, t) for bits, t in settings.blocks]
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 5000):
                part, shift = fps[lo : lo + 5000], 0
                for k, code in enumerate(codes):
                    values = part >> np.uint64(shift) & np.uint64((1 << code.bits) - 1)
                    shift += code.bits
                    found = [np.concatenate(x) for x in zip(*code.anchors(values))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found[0]), k, dtype=np.int32)), pa.array(found[1].astype(np.int64)), pa.array(found[2]), pa.array(part[found[0]].view(np.int64))],
                        names=["block", "anchor", "home", "fp"],
                    )

    return prints.select("fp").mapInArrow(run, "block int, anchor bigint, home boolean, fp bigint")


def dealt(rows: DataFrame, split: int) -> DataFrame:
    """Rows with cell and role (0: among all, 1: both, 2: at home): anchors with more than ``split``
    fingerprints become a grid, in which each fingerprint at home meets all others once."""
    sizes = rows.groupBy("block", "anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    hot = written(sizes.where(F.col("n") > split), "hot_anchors")
    grid = rows.join(hot, ["block", "anchor"], "left")
    wide = F.ceil(F.col("n") / split).cast("int")
    high = F.ceil(F.col("h") / split).cast("int")
    column = F.pmod(F.xxhash64("fp"), wide).cast("int")
    line = F.pmod(F.xxhash64("fp"), high).cast("int")
    cell = lambda i, j, role: F.struct((i * wide + j).alias("cell"), F.lit(role).alias("role"))
    among = F.transform(F.sequence(F.lit(0), high - 1), lambda i: cell(i, column, 0))
    at_home = F.transform(F.sequence(F.lit(0), wide - 1), lambda j: cell(line, j, 2))
    both = F.array(F.struct(F.lit(0).alias("cell"), F.col("home").cast("int").alias("role")))
    places = F.when(F.col("n").isNull(), both).when(F.col("h") == 0, F.filter(both, lambda _: F.lit(False)))
    places = places.when(F.col("home"), F.concat(among, at_home)).otherwise(among)
    return grid.select("block", "anchor", "fp", F.inline(places))


def forest(fps: np.ndarray, roles: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever one anchor's comparisons connect."""
    nodes, at = np.unique(fps, return_inverse=True)
    label = np.arange(len(nodes))
    members = np.unique(at[roles <= 1])
    a, b = [], []
    for home in np.unique(at[roles >= 1]):
        near = members[np.bitwise_count(nodes[members] ^ nodes[home]) <= distance]
        labels = np.unique(np.append(label[near], label[home]))
        if len(labels) > 1:
            a += [nodes[labels[0]]] * (len(labels) - 1)
            b += list(nodes[labels[1:]])
            label[np.isin(label, labels)] = labels[0]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def compare(fps: np.ndarray, roles: np.ndarray, starts: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of many anchors; rows of an anchor lie together, from one of ``starts`` on."""
    ends = np.append(starts[1:], len(fps))
    homes = np.add.reduceat(roles >= 1, starts) if len(starts) else starts
    pairs = homes * (ends - starts)
    for g in np.flatnonzero(pairs > SMALL):
        yield forest(fps[starts[g] : ends[g]], roles[starts[g] : ends[g]], distance)
    small = np.flatnonzero((pairs > 0) & (pairs <= SMALL) & (ends - starts > 1))
    of = np.repeat(np.arange(len(starts)), ends - starts)
    wanted = np.zeros(len(starts), dtype=bool)
    wanted[small] = True
    home = np.flatnonzero((roles >= 1) & wanted[of])
    step = max(1, PAIRS // SMALL)
    for lo in range(0, len(home), step):
        own = home[lo : lo + step]
        n = (ends - starts)[of[own]]
        left = np.repeat(own, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of[own]], n)
        ok = (roles[right] <= 1) & (fps[left] != fps[right])
        ok &= np.bitwise_count(fps[left] ^ fps[right]) <= distance
        if ok.any():
            yield fps[left[ok]], fps[right[ok]]


def links(prints: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct) that connect all that are near."""
    rows = dealt(at_anchors(prints, settings), settings.split)
    rows = rows.repartition("block", "anchor", "cell").sortWithinPartitions("block", "anchor", "cell")
    distance = settings.distance

    def run(batches):
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "anchor", "cell", "fp", "role")]
            now = [np.concatenate(x) for x in zip(rest, now)] if rest else now
            change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)) + 1
            cut = change[-1] if len(change) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield from found(now[3][:cut], now[4][:cut], np.append(0, change[:-1]))
        if rest and len(rest[0]):
            yield from found(rest[3], rest[4], np.array([0]))

    def found(fps, roles, starts):
        for a, b in compare(fps.view(np.uint64), roles, starts, distance):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: SimHashSettings = SimHashSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep``, fp, root (the component's smallest fingerprint) and component_id (its smallest key) of every row."""
    prints = written(fingerprints(docs, (key, *keep), text, settings), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct_fingerprints")
    roots = components(links(distinct, settings))
    place = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    place = written(place, "places")
    names = place.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(place.join(names, "root").select("fp", "root", "component_id"), "components")
    return prints.join(named, "fp", "left").select(key, *keep, "fp", "root", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the one with the smallest key stays."""
    mark = free_name(docs, "text_hash_")
    hashed = docs.withColumn(mark, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    placed = near_duplicates(hashed, key, text, settings, (mark,))
    first = F.min(F.struct(F.col(key).isNull(), F.col(key), F.col(mark)))
    chosen = placed.groupBy("root").agg(first.alias("first"))
    chosen = chosen.select(F.col(f"first.{key}").alias("key_"), F.col(f"first.{mark}").alias("mark_"))
    same = placed.groupBy(F.col(key).alias("key_"), F.col(mark).alias("mark_")).agg(F.count("*").alias("rows_"))
    same_row = F.col("key_").eqNullSafe(F.col("k_")) & (F.col("mark_") == F.col("m_"))
    chosen = chosen.join(same.select(F.col("key_").alias("k_"), F.col("mark_").alias("m_"), "rows_"), same_row).select("key_", "mark_", "rows_")
    chosen = written(chosen, "chosen")
    match = hashed[key].eqNullSafe(chosen["key_"]) & (hashed[mark] == chosen["mark_"])
    if chosen.where("rows_ > 1").isEmpty():
        return hashed.join(chosen, match, "left_semi").select(*docs.columns)
    once = hashed.join(chosen.where("rows_ = 1"), match, "left_semi")
    again = hashed.join(chosen.where("rows_ > 1"), match, "left_semi").dropDuplicates([key, mark])
    return once.union(again).select(*docs.columns)
