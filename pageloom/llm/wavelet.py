"""Token-id shards as wavelet matrices.

A shard file holds the ids of its documents, end ids included, in ascending order of their
identifiers: one bit plane per bit of an id, from the highest, each in the order the planes
before it give (zeros first). Counts of ones, sampled every 512 positions, are stored with
the planes; with them the planes give access to any token, counts of an id before a position,
and the place of its k-th occurrence, all from the one file. The matrix is cut into blocks of
``BLOCK`` positions, each compressed by itself, so that a look-up decompresses one block (or,
for an id's occurrences, one after the other) and building works within the cache.

Layout, little-endian: 8 bytes ``PLWM0002``; header length (u4) and header, JSON with
``tokens``, ``documents``, ``planes``, ``block`` and the compressed lengths of ``tables`` and
``blocks``; then these, each zstandard: identifiers (i8), null marks (u1), token counts (i8);
of each block, plane by plane, the ones before every 512th position (u4) and the bits, eight
positions a byte, lowest bit first.

Documents are range-partitioned by identifier; a task closes a file after ``file_tokens``,
so its memory does not grow with the shard. Defined results: a null text is one end id;
null identifiers come first; rows with equal identifiers lie in the order of a hash of
their text. An empty table writes no file. Other columns are left out.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm import storage
from pageloom.llm.common import written
from pageloom.llm.tokens import encoder

MAGIC = b"PLWM0002"
FILE_TOKENS = 8 << 20
BATCH_TOKENS = 1 << 20
BLOCK = 1 << 18  # positions
SAMPLE = 512  # positions between two stored counts of ones
TABLES = ("<i8", "<u1", "<i8")


class WaveletMatrix:
    """Bit planes of a sequence of ids, packed, lowest bit first, and their samples of ones."""

    def __init__(self, planes: list[np.ndarray], samples: list[np.ndarray], n: int):
        self.planes, self.samples, self.n = planes, samples, n

    @classmethod
    def of(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        packed, samples, now = [], [], np.ascontiguousarray(ids)
        for shift in range(planes - 1, -1, -1):
            bytes_ = now.view(np.uint8)[shift >> 3 :: now.itemsize]
            bits = (bytes_ & np.uint8(1 << (shift & 7))).view(np.uint8).astype(bool)
            packed.append(np.packbits(bits, bitorder="little"))
            samples.append(ones_before(packed[-1]))
            zeros = len(now) - int(np.count_nonzero(bits))
            ordered = np.empty_like(now)
            np.compress(~bits, now, out=ordered[:zeros])
            np.compress(bits, now, out=ordered[zeros:])
            now = ordered
        return cls(packed, samples, len(ids))

    @cached_property
    def _zeros(self) -> list[int]:
        return [self.n - self._ones(plane, self.n) for plane in range(len(self.planes))]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position ``i``."""
        at = i // SAMPLE
        bits = int.from_bytes(self.planes[plane][at * SAMPLE // 8 : (i + 7) // 8].tobytes(), "little")
        return int(self.samples[plane][at]) + (bits & (1 << i - at * SAMPLE) - 1).bit_count()

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(len(self.planes)):
            bit, ones = int(self.planes[plane][i >> 3]) >> (i & 7) & 1, self._ones(plane, i)
            value = value << 1 | bit
            i = self._zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the value's occurrences before ``end`` lie below the last plane."""
        if value < 0 or value >> len(self.planes):
            return 0, 0
        lo, hi = 0, end
        for plane in range(len(self.planes)):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if value >> len(self.planes) - 1 - plane & 1:
                lo, hi = self._zeros[plane] + a, self._zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """How often the id occurs before position ``end``."""
        lo, hi = self._range(value, end)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Position of occurrence k, from 0."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = value >> len(self.planes) - 1 - plane & 1
            at = self._nth(plane, at - self._zeros[plane] if one else at, one)
        return at

    def _nth(self, plane: int, k: int, one: int) -> int:
        """Position of the k-th bit of a kind: the last sample not beyond it, then the stretch behind."""
        before = self.samples[plane].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * SAMPLE - before
        at = int(np.searchsorted(before, k, side="right")) - 1
        stretch = np.unpackbits(self.planes[plane][at * SAMPLE // 8 : (at + 1) * SAMPLE // 8], bitorder="little")
        return at * SAMPLE + int(np.flatnonzero(stretch == one)[k - int(before[at])])

    def places(self, value: int) -> np.ndarray:
        """Positions of all occurrences, found from the last plane up, all together."""
        lo, hi = self._range(value, self.n)
        at = np.arange(lo, hi)
        for plane in range(len(self.planes) - 1, -1, -1):
            if not len(at):
                break
            one = value >> len(self.planes) - 1 - plane & 1
            bits = np.unpackbits(self.planes[plane], count=self.n, bitorder="little")
            at = np.flatnonzero(bits == one)[at - self._zeros[plane] if one else at]
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for shift, plane in enumerate(reversed(self.planes)):
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = self.n - int(np.count_nonzero(bits))
            above = np.empty(self.n, dtype=kind)
            above[np.flatnonzero(~bits)] = now[:zeros]
            above[np.flatnonzero(bits)] = now[zeros:] | kind(1 << shift)
            now = above
        return now

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for pair in zip(self.samples, self.planes) for x in pair)

    @classmethod
    def from_bytes(cls, data: bytes, n: int, planes: int) -> WaveletMatrix:
        n_samples, n_bytes = n // SAMPLE + 1, (n + 7) // 8
        samples, packed = [], []
        for at in range(0, planes * (4 * n_samples + n_bytes), 4 * n_samples + n_bytes):
            samples.append(np.frombuffer(data, "<u4", n_samples, at))
            packed.append(np.frombuffer(data, np.uint8, n_bytes, at + 4 * n_samples))
        return cls(packed, samples, n)


def ones_before(plane: np.ndarray) -> np.ndarray:
    """Ones before every ``SAMPLE``-th position, from 0 on."""
    step = SAMPLE // 8
    whole = np.zeros((len(plane) // step + 1) * step, dtype=np.uint8)
    whole[: len(plane)] = plane
    ones = np.bitwise_count(whole.view("<u8")).reshape(-1, step // 8).sum(axis=1)
    return np.append(0, np.cumsum(ones))[: len(ones)].astype("<u4")


class Shard:
    """A shard file, of which only what is asked for is fetched: ``fetch(offset, length)`` gives its bytes."""

    def __init__(self, fetch: Callable[[int, int], bytes]):
        self.fetch = fetch
        start = fetch(0, 12)
        if start[:8] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<I", start, 8)
        header = json.loads(fetch(12, size))
        self.n, self.planes, self.block = header["tokens"], header["planes"], header["block"]
        lengths = header["tables"] + header["blocks"]
        self.offsets = np.append(0, np.cumsum(lengths)) + 12 + size
        self.n_blocks = len(header["blocks"])
        self.held: tuple[int, WaveletMatrix] | None = None

    @classmethod
    def open(cls, uri: str) -> Shard:
        store, path = storage.opened(uri)
        file = store.open_input_file(path)
        return cls(lambda offset, length: file.read_at(length, offset))

    def _part(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.fetch(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i])))

    def tables(self) -> tuple[list[int | None], np.ndarray]:
        """Identifiers and token counts of the documents."""
        keys, gone, counts = (np.frombuffer(self._part(i), kind) for i, kind in enumerate(TABLES))
        return [None if g else k for k, g in zip(keys.tolist(), gone.tolist())], counts

    def matrix(self, block: int) -> WaveletMatrix:
        if self.held is None or self.held[0] != block:
            n = min(self.block, self.n - block * self.block)
            self.held = block, WaveletMatrix.from_bytes(self._part(len(TABLES) + block), n, self.planes)
        return self.held[1]

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.matrix(i // self.block).access(i % self.block)

    def rank(self, value: int, end: int) -> int:
        whole, rest = divmod(end, self.block)
        return sum(self.matrix(b).count(value) for b in range(whole)) + (self.matrix(whole).rank(value, rest) if rest else 0)

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        for block in range(self.n_blocks if k >= 0 else 0):
            here = self.matrix(block).count(value)
            if k < here:
                return block * self.block + self.matrix(block).select(value, k)
            k -= here
        raise IndexError(k)

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.matrix(b).tokens() for b in range(self.n_blocks)])


def to_file(keys: list[int | None], ids: list[np.ndarray], planes: int) -> bytes:
    joined = np.concatenate(ids)
    tables = ([k or 0 for k in keys], [k is None for k in keys], [len(x) for x in ids])
    compress = zstandard.ZstdCompressor(level=1).compress
    first = [compress(np.array(t, dtype=kind).tobytes()) for t, kind in zip(tables, TABLES)]
    blocks = [compress(WaveletMatrix.of(joined[at : at + BLOCK], planes).to_bytes()) for at in range(0, len(joined), BLOCK)]
    header = {"tokens": len(joined), "documents": len(keys), "planes": planes, "block": BLOCK, "tables": [len(x) for x in first], "blocks": [len(x) for x in blocks]}
    packed = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(packed)), packed, *first, *blocks])


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, Shard]:
    """Identifiers, token counts and matrix of a shard file."""
    shard = Shard(lambda offset, length: data[offset : offset + length])
    return *shard.tables(), shard


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files; returns their list: uri, first (ids of all files before), n_documents, n_tokens."""
    folder = storage.new_folder(docs.sparkSession, "token-shards")
    hash_ = F.xxhash64(text)
    rows = docs.select(F.col(key).cast("bigint").alias("key_"), F.col(text).alias("text_"), hash_.alias("hash_"))
    rows = rows.repartitionByRange("key_", "hash_").sortWithinPartitions("key_", "hash_").select("key_", "text_")

    def run(batches):
        encode, part, nr = encoder(vocabulary), TaskContext.get().partitionId(), 0
        planes = max(1, (encode.size - 1).bit_length())
        end = np.array([end_id], dtype=encode.dtype)
        keys, ids, n = [], [], 0

        def close():
            uri, out = storage.create(folder, f"shard-{part:06d}-{nr:04d}", ".plwm")
            with out:
                out.write(to_file(keys, ids, planes))
            return pa.RecordBatch.from_pylist([{"part": part, "nr": nr, "uri": uri, "n_documents": len(keys), "n_tokens": n}], schema=FILES)

        for batch in batches:
            for k, t in zip(batch.column("key_").to_pylist(), batch.column("text_")):
                own = np.append(encode(t.as_py()), end)
                keys.append(k)
                ids.append(own)
                n += len(own)
                if n >= file_tokens:
                    yield close()
                    keys, ids, n, nr = [], [], 0, nr + 1
        if keys:
            yield close()

    files = written(rows.mapInArrow(run, "part int, nr int, uri string, n_documents bigint, n_tokens bigint"), "token_files")
    before = Window.orderBy("part", "nr").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"), "n_documents", "n_tokens")


FILES = pa.schema([("part", pa.int32()), ("nr", pa.int32()), ("uri", pa.string()), ("n_documents", pa.int64()), ("n_tokens", pa.int64())])


def read_shards(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, start, n_tokens and ids (unsigned 32-bit, little-endian) of every document in the files."""

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist()):
                keys, counts, shard = from_file(storage.read(uri))
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(counts)
                lo = 0
                while lo < len(keys):  # batches of bounded size
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - counts[lo] + BATCH_TOKENS)))
                    own = [ids[e - c : e].tobytes() for e, c in zip(ends[lo:hi], counts[lo:hi])]
                    columns = [pa.array(keys[lo:hi], pa.int64()), pa.array(first + ends[lo:hi] - counts[lo:hi]), pa.array(counts[lo:hi]), pa.array(own, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids"])
                    lo = hi

    n = max(1, files.count())
    return files.select("uri", "first").repartition(n).mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids binary")


def token_counts(files: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n) of each of ``ids``: how often it occurs in the files."""
    wanted = sorted(set(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                shard = Shard.open(uri)
                n = [0] * len(wanted)
                for block in range(shard.n_blocks):
                    matrix = shard.matrix(block)
                    n = [x + matrix.count(value) for x, value in zip(n, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])

    return files.select("uri").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def locate(files: DataFrame, ids: list[int]) -> DataFrame:
    """(id, position) of every occurrence of ``ids``; positions count the ids of all files."""
    wanted = sorted(set(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist()):
                shard = Shard.open(uri)
                for block in range(shard.n_blocks):
                    matrix, at = shard.matrix(block), first + block * shard.block
                    for value in wanted:
                        places = matrix.places(value) + at
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), value), pa.int64()), pa.array(places, pa.int64())], names=["id", "position"])

    return files.select("uri", "first").mapInArrow(run, "id bigint, position bigint")


def access(files: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, id) of ``positions(position)``; those beyond the last token have no row."""
    stretch = F.floor(F.col("position") / FILE_TOKENS)
    last = F.floor((F.col("first") + F.col("n_tokens") - 1) / FILE_TOKENS)
    spans = files.where("n_tokens > 0").select("uri", "first", "n_tokens", F.explode(F.sequence(F.floor(F.col("first") / FILE_TOKENS), last)).alias("stretch"))
    asked = positions.select("position", stretch.alias("stretch")).distinct()
    met = asked.join(spans, "stretch").where("position >= first AND position < first + n_tokens").select("uri", (F.col("position") - F.col("first")).alias("at"), "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, shard = None, None
        for batch in batches:
            found = []
            for own, at in zip(batch.column("uri").to_pylist(), batch.column("at").to_pylist()):
                if own != uri:
                    uri, shard = own, Shard.open(own)
                found.append(shard.access(at))
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(found, pa.int64())], names=["position", "id"])

    return met.repartition("uri").sortWithinPartitions("uri", "at").mapInArrow(run, "position bigint, id bigint")
