"""Spelling variants of words, found with a trie over letter-group counts.

Every code point belongs to one of 32 groups (its low five bits). A word's frequency vector
is how often each group occurs in it. One inserted code point raises one count, a deleted one
lowers one, a replaced one does both at most; so the vectors of near words differ by a surplus
of one and a deficit of one at most. The trie arranges words by the count of one group after
the other, the groups that vary most first. A depth-first search walks it with what is left
of both budgets, and the leaf words are verified code point by code point.

The trie is spread over tasks by its upper levels, a *head*: the counts of the first groups.
Words live under their own head and visit it, and, once for each pair of heads, also the
smaller heads that their budgets reach. How many levels form the head follows from the words
counted under all heads. A head with very many words is cut into blocks, each a trie of its
own that all visitors of the head search, and its visitors into blocks as well, so that a
task holds one block of words and a batch of visitors, whatever the skew. A task searches
for many visitors together: a node of the trie is entered with all that may go there.

Words and links stay tables. The statistics that reach the driver are the 32 variances and a
weighted mean a head length.

Defined results: null texts have no words; null identifiers count as empty. Texts are read
whole, in stretches that end between words. Repeated rows count as often as they occur. An
empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import slices, written
from pageloom.sources.scratch import Scratch

GROUPS = 32
LETTERS = [c for c in range(256) if chr(c) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or c >= 0xC0]
# All letters lie in Latin-1: other characters become blanks, A-Z lower case.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c in LETTERS else 32 for c in range(256))
STRETCH = 1 << 20  # code points read at a time
STRETCH_END = re.compile(r"[^A-Za-zÀ-ÿ]")
TALLY = 200_000  # distinct words a task counts before it hands them on
PAIRS = 1 << 18  # candidates held before they are verified
WIDE = 48  # code points; longer words are compared one by one


@dataclass(frozen=True)
class VariantSettings:
    min_points: int = 7
    min_n: int = 2
    damage: int = 31  # every so manieth (document, run) loses a code point; 0: none
    ratio: int = 10  # a form is so many times as frequent
    block: int = 24_000  # words of a trie block
    visitors: int = 96_000  # visitors of a cell
    batch: int = 16_384  # visitors searched together
    leaf: int = 64  # words of a node that is not divided any more
    most_levels: int = 8  # of a head


# --- words --------------------------------------------------------------------------------


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH:
        end = STRETCH_END.search(text, at + STRETCH)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def tally(key, text: str, s: VariantSettings) -> Iterator[tuple[bytes, int]]:
    """Words of a document, in Latin-1, and how often they occur in it."""
    runs: Counter[bytes] = Counter()
    for part in stretches(text):
        found = part.encode("latin-1", "replace").translate(WORD_BYTES).split()
        runs.update([w for w in found if len(w) >= s.min_points])
    prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
    for run, n in runs.items():
        if s.damage:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), prefix)
            if h % s.damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < s.min_points:
                    continue
        yield run, n


def counted_words(docs: DataFrame, key: str, text: str, s: VariantSettings) -> DataFrame:
    """(word, n) of the words that occur ``min_n`` times or more."""
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).where(F.col("text_").isNotNull())

    def flushed(counts: dict) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in slices(batches):
            for k, t in zip(batch.column("key_").to_pylist(), batch.column("text_")):
                for word, n in tally(k, t.as_py(), s):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= TALLY:
                    yield flushed(counts)
                    counts = {}
        yield flushed(counts)

    parts = rows.mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.min_n)


# --- frequency vectors --------------------------------------------------------------------


def vectors(words: list[str]) -> np.ndarray:
    """Frequency vectors, one row a word."""
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    flat = np.repeat(np.arange(len(words)), length) * GROUPS + (points & (GROUPS - 1)).astype(np.int64)
    return np.bincount(flat, minlength=len(words) * GROUPS).reshape(len(words), GROUPS).astype(np.int32)


def level_order(words: DataFrame) -> list[int]:
    """Groups from the one whose count varies most to the one that varies least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares, n = np.zeros(GROUPS), np.zeros(GROUPS), 0
        for batch in batches:
            if batch.num_rows:
                v = vectors(batch.column("word").to_pylist()).astype(np.float64)
                sums, squares, n = sums + v.sum(axis=0), squares + (v * v).sum(axis=0), n + len(v)
        columns = [pa.array(range(GROUPS), pa.int32()), pa.array(sums), pa.array(squares), pa.array([n] * GROUPS, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "x", "xx", "n"])

    parts = words.select("word").mapInArrow(run, "g int, x double, xx double, n bigint")
    total = parts.groupBy("g").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum("n").alias("n")).collect()
    spread = {r.g: r.xx / r.n - (r.x / r.n) ** 2 if r.n else 0.0 for r in total}
    return sorted(range(GROUPS), key=lambda g: (-spread.get(g, 0.0), g))


def head_counts(words: DataFrame, order: list[int], levels: int) -> DataFrame:
    """``words`` with ``head``, an array with the counts of the first groups."""
    fields = f"{', '.join(f'{n} {t}' for n, t in words.dtypes)}, head array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                head = vectors(batch.column("word").to_pylist())[:, order[:levels]]
                flat = pa.array(head.reshape(-1), pa.int32())
                ends = pa.array(np.arange(0, head.size + 1, levels), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, "head"])

    return words.mapInArrow(run, fields)


def head_length(words: DataFrame, s: VariantSettings) -> int:
    """The fewest levels at which a word shares its head with a block's worth of others, on average."""
    heads = words.groupBy("head").agg(F.count("*").alias("n"))
    for levels in range(2, s.most_levels):
        short = heads.groupBy(F.slice("head", 1, levels).alias("head")).agg(F.sum("n").alias("n"))
        total, squares = short.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
        if squares is None or squares / total <= s.block / 2:
            return levels
    return s.most_levels


# --- search -------------------------------------------------------------------------------


class Trie:
    """Words of a block, sorted by their counts group after group: each node is a range of rows."""

    def __init__(self, words: list[str], n: list[int], order: list[int], s: VariantSettings):
        counts = vectors(words)[:, order]
        at = np.lexsort(counts.T[::-1])
        self.words, self.n = [words[i] for i in at], np.array(n, dtype=np.int64)[at]
        self.counts, self.order, self.leaf = counts[at].astype(np.int16) if counts.max(initial=0) < 1 << 14 else counts[at], order, s.leaf
        self.points, self.odd = padded(self.words), parities(self.counts)
        self.ends = ends(self.words, self.points, s.min_points // 2)
        self.shared = s.min_points // 2

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, row) of the pairs of words at distance one."""
        if not words or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        visit = Visit(self, words)
        budget = np.ones(len(words), dtype=np.int8)
        visit.descend(0, len(self.words), 0, np.arange(len(words)), budget, budget)
        return visit.near()


class Visit:
    """One depth-first search of a trie for many words together."""

    def __init__(self, trie: Trie, words: list[str]):
        self.trie, self.words, self.points = trie, words, padded(words)
        self.counts = vectors(words)[:, trie.order].astype(trie.counts.dtype)
        self.odd, self.ends = parities(self.counts), ends(words, self.points, trie.shared)
        self.candidates: list[tuple[np.ndarray, np.ndarray]] = []
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.held = 0

    def descend(self, lo: int, hi: int, level: int, rows: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """``rows`` are the visitors at this node, with what is left of their budgets."""
        if hi - lo <= self.trie.leaf or level == GROUPS:
            step = max(1, PAIRS // (hi - lo))
            for at in range(0, len(rows), step):
                self.leaf(lo, hi, rows[at : at + step])
            return
        column = self.trie.counts[lo:hi, level]
        starts = np.flatnonzero(np.diff(column)) + 1
        edges = [lo, *(starts + lo).tolist(), hi]
        own = self.counts[rows, level]
        for a, b in zip(edges, edges[1:]):
            gap = self.trie.counts[a, level] - own
            more, less = surplus - np.maximum(gap, 0), deficit - np.maximum(-gap, 0)
            on = np.flatnonzero((more >= 0) & (less >= 0))
            if len(on):
                self.descend(a, b, level + 1, rows[on], more[on], less[on])

    def leaf(self, lo: int, hi: int, rows: np.ndarray) -> None:
        """Pairs whose counts are odd in the same groups but for the two that the budgets allow, and
        whose beginnings or ends agree, as one of them lies beyond the place where near words differ."""
        i, j = np.nonzero(np.bitwise_count(self.odd[rows, None] ^ self.trie.odd[None, lo:hi]) <= 2)
        i, j = rows[i], lo + j
        (begins, closes), (others, other_closes) = self.ends, self.trie.ends
        on = (begins[i] == others[j]) | (closes[i] == other_closes[j])
        if on.any():
            self.candidates.append((i[on], j[on]))
            self.held += int(on.sum())
            if self.held >= PAIRS:
                self.verify()

    def verify(self) -> None:
        """First whole frequency vectors, then code points."""
        a, b = (np.concatenate(x) for x in zip(*self.candidates))
        self.candidates, self.held = [], 0
        gap = self.trie.counts[b] - self.counts[a]
        on = (np.maximum(gap, 0).sum(axis=1) <= 1) & (np.minimum(gap, 0).sum(axis=1) >= -1)
        self.found.append(verified(self.words, self.points, a[on], self.trie.words, self.trie.points, b[on]))

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            self.verify()
        a, b = (np.concatenate(x) for x in zip(*self.found))
        return a, b


def parities(counts: np.ndarray) -> np.ndarray:
    """A bit for each group with an odd count."""
    return ((counts & 1).astype(np.uint32) << np.arange(GROUPS, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def ends(words: list[str], points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last ``n`` code points of each word."""
    begins, closes = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.array([[ord(c) for c in w[len(w) - n :]] for w in words], dtype=np.uint64).reshape(len(words), n) if n and size.max(initial=0) > WIDE else None
    for k in range(n):
        begins = begins * np.uint64(0x9E3779B97F4A7C15) + points[:, k]
        closes = closes * np.uint64(0x9E3779B97F4A7C15) + (points[np.arange(len(words)), size - n + k] if last is None else last[:, k])
    return begins, closes


def padded(words: list[str]) -> np.ndarray:
    """Code points of the words, one row each, zeros behind; longer ones than WIDE are cut."""
    shown = np.array([w[: WIDE + 1] for w in words], dtype=f"<U{WIDE + 1}")
    return shown.view("<u4").reshape(len(words), WIDE + 1)


def verified(words: list[str], points: np.ndarray, a: np.ndarray, others: list[str], other_points: np.ndarray, b: np.ndarray):
    """The pairs that differ by exactly one inserted, deleted or replaced code point."""
    keep = [np.zeros(0, dtype=bool)]
    size, other_size = np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, others), np.int64, len(others))
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        left, right, n, m = points[i], other_points[j], size[i], other_size[j]
        turn = n > m  # the shorter one to the left
        left[turn], right[turn] = right[turn], left[turn]
        n, m = np.minimum(n, m), np.maximum(n, m)
        differs = left != right
        replaced = (n == m) & (differs.sum(axis=1) == 1)
        shifted = left[:, :-1] != right[:, 1:]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), WIDE)
        last = np.where(shifted.any(axis=1), WIDE - 1 - shifted[:, ::-1].argmax(axis=1), -1)
        near = replaced | (m == n + 1) & (last < first)
        for k in np.flatnonzero(m > WIDE).tolist():
            near[k] = one_apart(words[i[k]], others[j[k]])
        keep.append(near)
    on = np.concatenate(keep)
    return a[on], b[on]


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return same < len(a) and a[same + 1 :] == b[same + 1 :]
    return len(b) == len(a) + 1 and a[same:] == b[same + 1 :]


def reached(levels: int) -> list[tuple[list[int], bool]]:
    """What to add to a head for every head a word visits: itself, and the smaller ones within its budgets."""
    steps = [[0] * levels]
    for up in range(-1, levels):
        for down in range(-1, levels):
            if up != down:
                step = [0] * levels
                for at, change in ((up, 1), (down, -1)):
                    if at >= 0:
                        step[at] = change
                if step < [0] * levels:
                    steps.append(step)
    return steps


def links(words: DataFrame, order: list[int], s: VariantSettings) -> DataFrame:
    """(word, near, near_n) of every two near words, in both directions; ``words`` has word, n and head."""
    levels = head_length(words, s)
    words = words.withColumn("head", F.slice("head", 1, levels))
    sums: list[Column] = [F.array(*[F.element_at("head", k + 1) + x for k, x in enumerate(step)]) for step in reached(levels)]
    # Words by head, once; the visitors of a head are the words of all heads from which it is reached.
    living = words.groupBy("head").agg(F.count("*").alias("n_words"))
    coming = living.select("n_words", F.explode(F.array(*sums)).alias("head")).groupBy("head").agg(F.sum("n_words").alias("n_visitors"))
    blocks = living.join(coming, "head").select(
        "head", F.ceil(F.col("n_words") / s.block).cast("int").alias("blocks"), F.ceil(F.col("n_visitors") / s.visitors).cast("int").alias("turns")
    )
    blocks = Scratch(words.sparkSession).write_ordered(blocks, "heads", ["head"]).withColumnRenamed("ord", "cell")
    draw = F.xxhash64("word")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    residents = words.join(blocks, "head").select("cell", F.pmod(draw, F.col("blocks")).cast("int").alias("block"), each("turns").alias("turn"), F.lit(0).alias("role"), "word", "n")
    visits = words.select("word", "n", F.posexplode(F.array(*sums)).alias("step", "head"))
    visitors = visits.join(blocks, "head").select(
        "cell", each("blocks").alias("block"), F.pmod(draw, F.col("turns")).cast("int").alias("turn"), F.when(F.col("step") == 0, 1).otherwise(2).alias("role"), "word", "n"
    )
    cells = residents.unionByName(visitors).repartition("cell", "block", "turn").sortWithinPartitions("cell", "block", "turn", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, trie, block, waiting = None, None, ([], []), {1: ([], []), 2: ([], [])}

        def found(role: int) -> Iterator[pa.RecordBatch]:
            nonlocal trie
            names, n = waiting[role]
            if not names:
                return
            trie = trie or Trie(*block, order, s)
            a, b = trie.search(names)
            if role == 1:  # both live here, and each of the two visits
                on = np.fromiter((names[i] < trie.words[j] for i, j in zip(a.tolist(), b.tolist())), dtype=bool, count=len(a))
                a, b = a[on], b[on]
            left, right = [names[i] for i in a.tolist()], [trie.words[j] for j in b.tolist()]
            more = np.concatenate([trie.n[b], np.array(n, dtype=np.int64)[a]])
            names.clear(), n.clear()
            columns = [pa.array(left + right, pa.string()), pa.array(right + left, pa.string()), pa.array(more)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])

        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("cell", "block", "turn", "role")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            names, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for lo, hi in zip(edges, edges[1:]):  # rows of one cell and role
                *at, role = keys[:, lo].tolist()
                if at != cell:
                    yield from found(1)
                    yield from found(2)
                    cell, trie, block = at, None, ([], [])
                to = waiting[role] if role else block
                to[0].extend(names[lo:hi]), to[1].extend(n[lo:hi])
                if role and len(to[0]) >= s.batch:
                    yield from found(role)
        yield from found(1)
        yield from found(2)

    return cells.mapInArrow(run, "word string, near string, near_n bigint")


# --- forms and roots ----------------------------------------------------------------------


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms. A form is ten times as frequent, so chains are
    short and never closed; each round doubles the distance that is jumped."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = written(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: VariantSettings = VariantSettings()) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    s = settings
    words = written(counted_words(docs, key, text, s), "words")
    order = level_order(words)
    headed = written(head_counts(words, order, s.most_levels), "headed_words")
    near = links(headed, order, s).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    far_more = -F.col("best.m") >= s.ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(far_more, F.col("best.form")).alias("form"), F.when(far_more, -F.col("best.m")).alias("form_n"),
    )
    judged = written(judged, "judged_words")
    roots = with_roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
