"""Page numbers of documents whose pages break by a rule.

A page break depends on how full the page already is, and that on everything before. So what a
run of items does to a page is kept as a function: for every fill a page may have, how many
pages the run begins and how full the last one is after it. Such functions compose. Every
partition of a document's items, in order, works out its own; they are composed over the
partitions, one row each, which gives every partition the page and fill it starts with; and
then its items get their pages. No document passes through one task, however long it is.

``flow`` False starts every item on a new page; True continues where the last one ended, but
keeps its first ``keep`` lines together. Lines have one height.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.ordinals import PARTITION_SHIFT
from pageloom.sources.scratch import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LayoutSettings:
    lines: int = 45  # of a page
    contents_lines: int = 40  # entries of a contents page
    flow: bool = False
    keep: int = 3  # lines that stay together at the start of an item


def after(fill: np.ndarray, n: int, s: LayoutSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What an item of ``n`` lines does to pages of each ``fill`` (0: none begun): whether it starts a new
    page, how many pages it begins in all, and the fill behind it."""
    n = max(1, n)
    fresh = (fill == 0) | (fill + (min(n, s.keep) if s.flow else s.lines + 1) > s.lines)
    used = np.where(fresh, 0, fill) + n
    return fresh, (used - 1) // s.lines + fresh, (used - 1) % s.lines + 1


def _functions(batches: Iterator[pa.RecordBatch], s: LayoutSettings) -> Iterator[pa.RecordBatch]:
    """One row a document and partition: pages begun and fill reached from every fill."""
    rows, held = [], None
    for batch in batches:
        for document, part, n in zip(*(batch.column(c).to_pylist() for c in ("document", "part", "lines"))):
            if held is None or held[:2] != (document, part):
                if held is not None:
                    rows.append(held)
                held = (document, part, np.zeros(s.lines + 1, np.int64), np.arange(s.lines + 1))
            _, begun, fill = after(held[3], n, s)
            held = (document, part, held[2] + begun, fill)
    if held is not None:
        rows.append(held)
    names = ["document", "part", "pages", "fill"]
    columns = zip(*((d, p, a.tolist(), b.tolist()) for d, p, a, b in rows)) if rows else [[]] * 4
    types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages begun before each partition of a document, and the fill it starts with."""
    document, begun, fill = None, 0, 0
    for batch in batches:
        out = []
        for own, part, pages, reached in zip(*(batch.column(c).to_pylist() for c in ("document", "part", "pages", "fill"))):
            if own != document:
                document, begun, fill = own, 0, 0
            out.append((own, part, begun, fill))
            begun, fill = begun + pages[fill], reached[fill]
        columns = list(zip(*out)) or [[]] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["document", "part", "begun", "fill"])


def _pages(batches: Iterator[pa.RecordBatch], s: LayoutSettings) -> Iterator[pa.RecordBatch]:
    """``first_page`` and ``last_page`` of every item."""
    held, begun, fill = None, 0, np.zeros(1, np.int64)
    for batch in batches:
        first, last = [], []
        for *own, n, start, start_fill in zip(*(batch.column(c).to_pylist() for c in ("document", "part", "lines", "begun", "fill"))):
            if own != held:
                held, begun, fill = own, start, np.array([start_fill])
            fresh, pages, fill = after(fill, n, s)
            first.append(begun + int(fresh[0]))
            begun += int(pages[0])
            last.append(begun)
        yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["ord", "first_page", "last_page"])


def laid_out(items: DataFrame, document: str, order: list[str], lines: str, scratch: Scratch, settings: LayoutSettings = LayoutSettings()) -> DataFrame:
    """``items`` with ``first_page`` and ``last_page``, counted from 1 within each document.

    ``order`` is unique within a document; ``lines`` is how many lines an item has, one at least.
    Null documents form one.
    """
    s = settings
    placed = scratch.write_ordered(items, "layout", [document, *order])
    rows = placed.select(
        F.concat(F.when(F.col(document).isNull(), "n").otherwise("d"), F.coalesce(F.col(document).cast("string"), F.lit(""))).alias("document"),
        F.shiftright("ord", PARTITION_SHIFT).alias("part"), "ord", F.col(lines).cast("int").alias("lines"),
    )
    ordered = rows.repartition("part").sortWithinPartitions("part", "ord")
    functions = scratch.write(ordered.select("document", "part", "lines").mapInArrow(lambda b: _functions(b, s), "document string, part bigint, pages array<bigint>, fill array<bigint>"), "page_functions")
    starts = functions.repartition("document").sortWithinPartitions("document", "part").mapInArrow(_starts, "document string, part bigint, begun bigint, fill bigint")
    met = rows.join(starts, ["document", "part"]).repartition("part").sortWithinPartitions("part", "ord")
    pages = met.select("document", "part", "ord", "lines", "begun", "fill").mapInArrow(lambda b: _pages(b, s), "ord bigint, first_page bigint, last_page bigint")
    return placed.join(pages, "ord").drop("ord")
