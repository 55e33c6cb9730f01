"""Order-preserving packing of token streams into windows, by dynamic programming.

The documents of a partition, each followed by an end id, are one stream in their given
order. Windows are stretches of at most ``window`` ids. Where a window may end: at a
document's end (free), after a sentence (small penalty), and, in stretches of more than a
window without either, every ``grain`` ids (larger penalty). The least sum of padding, penalties and a small cost
per window is found from left to right: the best start of a window that ends here is the
least of (cost + position) over the places at most ``window`` ids back, which a monotone
queue keeps ready. Windows whose length is a power of two need no padding and are tried
besides.

A stream is packed in blocks of whole documents with about ``block_tokens`` ids, so
memory does not grow with the partition. Nothing is shuffled. Window numbers are unique,
with the partition's number in their upper bits.

Defined results: a null or empty text is its end id alone. Every id lies in exactly one
piece, whatever the length of the document. Rows that repeat are packed once each. An
empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import slices
from pageloom.llm.tokens import encoder

PARTITION_SHIFT = 33
BATCH_TOKENS = 1 << 18
SENTENCE_END = re.compile(r"[.!?…]+[\"')\]]*(?:</w>)?")


@dataclass(frozen=True)
class PackingSettings:
    window: int = 2048
    sentence_cut: int = 8  # penalties, in tokens of padding
    hard_cut: int = 48
    window_cost: int = 32
    grain: int = 64
    shortest: int = 64  # smallest window tried without padding
    block_tokens: int = 1 << 19


def places(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, s: PackingSettings) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, from 0 on, and the penalty of each."""
    penalty = np.full(len(ids) + 1, -1, dtype=np.int32)
    penalty[1:][stops[ids]] = s.sentence_cut
    penalty[ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    for i in np.flatnonzero(np.diff(at) > s.window):
        penalty[at[i] + s.grain : at[i + 1] : s.grain] = s.hard_cut
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def cuts(at: np.ndarray, penalty: np.ndarray, s: PackingSettings) -> np.ndarray:
    """Positions at which the windows of the cheapest packing end, 0 in front."""
    where = np.full(int(at[-1]) + 1, -1, dtype=np.int32)
    where[at] = np.arange(len(at))
    exact: dict[int, list[int]] = {}
    size = s.shortest
    while size < s.window:
        back = at - size
        found = np.flatnonzero((back >= 0) & (where[np.maximum(back, 0)] >= 0))
        for j, i in zip(found.tolist(), where[back[found]].tolist()):
            exact.setdefault(j, []).append(i)
        size *= 2
    position, fee = at.tolist(), (penalty + s.window_cost).tolist()
    cost, start = [0] * len(position), [0] * len(position)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, place), both rising
    for j in range(1, len(position)):
        here = position[j]
        while position[queue[0][1]] < here - s.window:
            queue.popleft()
        least, i = queue[0]
        best = least + s.window - here
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], start[j] = best + fee[j], i
        value = cost[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    ends, j = [position[-1]], len(position) - 1
    while j:
        j = start[j]
        ends.append(position[j])
    return np.array(ends[::-1])


def pieces(ids: np.ndarray, counts: np.ndarray, stops: np.ndarray, s: PackingSettings) -> tuple[np.ndarray, ...]:
    """Of each piece: document (place in ``counts``), start there, length, window, offset there."""
    ends = np.cumsum(counts)
    ends_of_windows = cuts(*places(ids, ends, stops, s), s)
    edges = np.union1d(ends_of_windows, np.append(0, ends))
    left, length = edges[:-1], np.diff(edges)
    doc = np.searchsorted(ends, left, side="right")
    window = np.searchsorted(ends_of_windows, left, side="right") - 1
    return doc, left - (ends - counts)[doc], length, window, left - ends_of_windows[window]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, key: str = "doc_id", text: str = "text", settings: PackingSettings = PackingSettings()) -> DataFrame:
    """``key``, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id and offset of every piece."""
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    kind = dict(rows.dtypes)["key_"]
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        stops = np.zeros(encode.size, dtype=bool)
        stops[[i for t, i in encode.library.get_vocab().items() if SENTENCE_END.fullmatch(t)]] = True
        end = np.array([end_id], dtype=encode.dtype)
        keys, ids, n, first = [], [], 0, TaskContext.get().partitionId() << PARTITION_SHIFT

        def packed():
            nonlocal first
            stream, counts = np.concatenate(ids), np.array([len(x) for x in ids])
            doc, start, length, window, offset = pieces(stream, counts, stops, s)
            edges = np.append(0, np.cumsum(length))
            lo = 0
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BATCH_TOKENS)) - 1)
                own = [stream[a:b].astype("<u4").tobytes() for a, b in zip(edges[lo:hi], edges[lo + 1 : hi + 1])]
                columns = [start[lo:hi], length[lo:hi], own, counts[doc[lo:hi]], first + window[lo:hi], offset[lo:hi]]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                taken = pa.array(keys, field.type).take(pa.array(doc[lo:hi]))
                yield pa.RecordBatch.from_arrays([taken, *(pa.array(c, t) for c, t in zip(columns, types))], names=NAMES)
                lo = hi
            first += int(window[-1]) + 1

        for batch in slices(batches):
            field = batch.schema.field("key_")
            for k, t in zip(batch.column("key_"), batch.column("text_")):
                own = np.append(encode(t.as_py()), end)
                keys.append(k.as_py())
                ids.append(own)
                n += len(own)
                if n >= s.block_tokens:
                    yield from packed()
                    keys, ids, n = [], [], 0
        if keys:
            yield from packed()

    found = rows.mapInArrow(run, f"key_ {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return found.withColumnRenamed("key_", key)


NAMES = ["key_", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
