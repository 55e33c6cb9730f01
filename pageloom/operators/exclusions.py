"""Excluded entries as a table of any size: which URLs contain one of them, anywhere.

A few entries are literals in a plan (``config.excluded_paths``); a list of many is a table. Every entry
is found through its first characters, its *head* (three, or all of a shorter one): a URL that contains
the entry contains the head. A bit map of the heads, of a fixed size, tells for each URL which of its
substrings may be heads, and the URL goes to those alone. At a head its entries are one
multi-pattern automaton (goto and failure links), which reads a URL once however many
entries it has. Heads with very many entries are cut into blocks, and those with very many
URLs into turns; a cell is one block and one turn, so that no task holds more than one
automaton of a bounded size or reads more than a bounded number of URLs with it.

Each distinct URL is tried once. Null URLs contain nothing; null and empty entries exclude nothing.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.sources.scratch import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 3  # characters
MAP_BITS = 24  # 2 MB
BLOCK = 10_000  # entries of an automaton
TURN = 200_000  # URLs of a cell


class Automaton:
    """Entries as a trie with failure links: states are numbers, steps a dict a state."""

    def __init__(self, entries: list[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.ends = [False]
        for entry in entries:
            at = 0
            for c in entry:
                if c not in self.steps[at]:
                    self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(False)
                at = self.steps[at][c]
            self.ends[at] = True
        self.fails = [0] * len(self.steps)
        queue = list(self.steps[0].values())
        for state in queue:  # grows while it is read: nearest states first
            for c, below in self.steps[state].items():
                queue.append(below)
                back = self.fails[state]
                while back and c not in self.steps[back]:
                    back = self.fails[back]
                self.fails[below] = self.steps[back].get(c, 0)
                self.ends[below] |= self.ends[self.fails[below]]

    def occurs_in(self, text: str) -> bool:
        state, steps, fails, ends = 0, self.steps, self.fails, self.ends
        for c in text:
            while state and c not in steps[state]:
                state = fails[state]
            state = steps[state].get(c, 0)
            if ends[state]:
                return True
        return False


def place(head: str) -> int:
    """Bit of a head in the map."""
    return zlib.crc32(head.encode("utf-8", "surrogatepass")) & (1 << MAP_BITS) - 1


def head_map(heads: DataFrame) -> np.ndarray:
    """Bit map of the heads; at most 2**MAP_BITS positions reach the driver, however many there are."""
    found = heads.select((F.crc32(F.col("head").cast("binary")) % (1 << MAP_BITS)).cast("int").alias("at")).distinct().toArrow().column("at")
    bits = np.zeros(1 << MAP_BITS, dtype=bool)
    bits[found.to_numpy()] = True
    return np.packbits(bits, bitorder="little")


def excluded_urls(urls: DataFrame, entries: DataFrame, scratch: Scratch, block: int = BLOCK, turn: int = TURN) -> DataFrame:
    """The distinct ``url`` that contain an ``entry``."""
    known = scratch.write(entries.where("entry <> ''").select("entry", F.substring("entry", 1, HEAD).alias("head")).distinct(), "entries")
    sizes = scratch.write(known.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "entry_heads")
    bits = urls.sparkSession.sparkContext.broadcast(head_map(sizes))
    distinct = urls.select("url").where("url IS NOT NULL").distinct()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bits.value
        for batch in batches:
            at, found = [], []
            for number, url in enumerate(batch.column("url").to_pylist()):
                for head in {url[i : i + n] for n in range(1, HEAD + 1) for i in range(len(url) - n + 1)}:
                    bit = place(head)
                    if packed[bit >> 3] >> (bit & 7) & 1:
                        at.append(number)
                        found.append(head)
            yield pa.RecordBatch.from_arrays([batch.column("url").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["text", "head"])

    asked = scratch.write(distinct.mapInArrow(heads, "text string, head string"), "asked_heads")
    loads = asked.groupBy("head").agg(F.ceil(F.count("*") / turn).cast("int").alias("turns"))
    loads = scratch.write(sizes.join(loads, "head"), "head_loads")

    def each(n: str, name: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)

    def one_of(text: str, n: str, name: str):
        return F.pmod(F.xxhash64(text), F.col(n)).cast("int").alias(name)

    urls_ = asked.join(loads, "head").select("head", one_of("text", "turns", "turn"), F.lit(1).alias("role"), "text", each("blocks", "block"))
    own = known.join(loads, "head").select("head", one_of("entry", "blocks", "block"), F.lit(0).alias("role"), F.col("entry").alias("text"), each("turns", "turn"))
    cells = own.unionByName(urls_).repartition("head", "block", "turn").sortWithinPartitions("head", "block", "turn", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, automaton = None, [], None
        for batch in batches:
            hits = []
            for *at, role, text in zip(*(batch.column(n).to_pylist() for n in ("head", "block", "turn", "role", "text"))):
                if at != cell:
                    cell, held, automaton = at, [], None
                if not role:
                    held.append(text)
                    continue
                automaton = automaton or Automaton(held)
                if automaton.occurs_in(text):
                    hits.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], names=["url"])

    return cells.mapInArrow(search, "url string").distinct()
