"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams, as indicators: all runs of one to three UTF-8 bytes,
hashed to 2**bits buckets, and the patterns of repetition in runs of four words (which of
them are equal), six bits each. Indicators are scaled by their log-count ratio between the
two classes, a text's vector to length one, and a linear hinge-loss model is fitted to them
by dual coordinate descent: one training row's multiplier after the other moves to its best
value between 0 and C. A logistic curve through the margins of rows kept out of the training
gives probabilities, weighted by the classes' shares among all labelled rows.

Training uses ``per_label`` labelled rows of each class at most, those with the smallest
hashes of their identifiers. They reach the driver as bit maps of (2**bits + 64) / 8 bytes,
so their size is bounded in bytes (16 MB by default). Scoring reads every text once, whole.

Defined results: null and empty texts have no indicator and get the score of the model's
constant. Without a labelled row every score is 0.5; with rows of one class alone, it is that
class's smoothed share. Labels other than 0 and 1 are ignored; a row that occurs with both
counts for both; repeated label rows count once. Long texts are read a megabyte at a time,
with overlaps, so that no n-gram is lost. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_text, written

SLICE = 1 << 20  # bytes worked on at a time
WORDS = 4  # of a pattern; it has a bit for each of their six pairs
PATTERNS = 64


@dataclass(frozen=True)
class ClassifierSettings:
    per_label: int = 1000  # training rows of each class at most; the bound of the sample
    bits: int = 16  # 2**bits buckets of byte n-grams
    smoothing: float = 1.0
    cost: float = 1.0  # C of the hinge loss
    epochs: int = 30
    tolerance: float = 1e-3
    seed: int = 11

    @property
    def size(self) -> int:
        return (1 << self.bits) + PATTERNS


@dataclass
class QualityModel:
    """``weights`` are those of raw indicators; ``squares`` give a text's length."""

    weights: np.ndarray
    squares: np.ndarray
    constant: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    settings: ClassifierSettings = field(default_factory=ClassifierSettings)

    def margin(self, on: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[on].sum()))
        return (float(self.weights[on].sum()) / length if length else 0.0) + self.constant

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(np.flatnonzero(indicators(text, self.settings))) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


# --- indicators -----------------------------------------------------------------------------


def indicators(text: str | None, s: ClassifierSettings) -> np.ndarray:
    """Which buckets and patterns a text has."""
    mark = np.zeros(s.size, dtype=bool)
    raw = (text or "").encode("utf-8", "surrogatepass")
    for at in range(0, len(raw), SLICE):
        points = np.frombuffer(raw, np.uint8, min(len(raw) - at, SLICE + 2), at).astype(np.uint32)
        hash_ = np.zeros(len(points), dtype=np.uint32)
        for n in (1, 2, 3):
            if len(points) >= n:
                hash_ = hash_[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :]
                h = hash_ + np.uint32(n)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA77)
                mark[h >> np.uint32(32 - s.bits)] = True
    before: list[bytes] = []
    for part in parts(raw):
        words = before + part.split()
        mark[(1 << s.bits) + patterns(words)] = True
        before = words[max(0, len(words) - WORDS + 1) :]
    return mark


def parts(raw: bytes):
    """Stretches of about a megabyte that end before a blank."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end]
        at = end


def patterns(words: list[bytes]) -> np.ndarray:
    """Of every run of four words, which pairs of them are equal."""
    n = len(words) - WORDS + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    found, bit = np.zeros(n, dtype=np.int64), 0
    for i in range(WORDS):
        for j in range(i + 1, WORDS):
            found |= (ids[i : n + i] == ids[j : n + j]).astype(np.int64) << bit
            bit += 1
    return found


# --- training -------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, label: str, s: ClassifierSettings) -> tuple[list, dict]:
    """(bit map, label) of the sampled rows, and how many labelled rows each class has in all."""
    known = labels.select(F.col(label_key).alias("key_"), F.col(label).cast("int").alias("label_")).where("label_ IN (0, 1) AND key_ IS NOT NULL").distinct()
    known = written(known.withColumn("draw_", F.xxhash64("key_", F.lit(s.seed))), "labels")
    counts = {r.label_: r["count"] for r in known.groupBy("label_").count().collect()}
    one, other = (known.where(F.col("label_") == v).orderBy("draw_", "key_").limit(s.per_label) for v in (0, 1))
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).where(F.col("text_").isNotNull())
    sample = rows.join(F.broadcast(one.unionByName(other)), "key_")  # 2 * per_label rows
    schema = pa.schema([("draw_", pa.int64()), ("label_", pa.int32()), ("bits", pa.binary())])

    def bits(value):
        return (np.packbits(indicators(value, s)).tobytes(),)

    read = sample.mapInArrow(lambda b: by_text(b, "text_", bits, schema, ("draw_", "label_")), "draw_ bigint, label_ int, bits binary")
    # A key that several documents share could bring more rows than were drawn.
    first = read.orderBy("draw_", "label_", "bits").limit(2 * s.per_label).collect()
    return [(np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=s.size)), r.label_) for r in first], counts


def ratios(rows: list, s: ClassifierSettings) -> np.ndarray:
    """Log of how much more often an indicator is on in class 1 than in class 0."""
    seen, n = np.full((2, s.size), s.smoothing), np.zeros(2)
    for on, y in rows:
        seen[y, on] += 1
        n[y] += 1
    p = seen / (n[:, None] + 2 * s.smoothing)
    return np.log(p[1] / p[0])


def descend(rows: list, scale: np.ndarray, s: ClassifierSettings) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model, by dual coordinate descent."""
    data = []
    for on, y in rows:
        x = scale[on]
        length = np.sqrt((x * x).sum())
        data.append((on, x / length if length else x, 1 if y else -1))
    weights, constant, rng = np.zeros(s.size), 0.0, np.random.default_rng(s.seed)
    held, curve = np.zeros(len(data)), np.array([(x * x).sum() + 1 for _, x, _ in data])
    for _ in range(s.epochs):
        worst = 0.0
        for i in rng.permutation(len(data)):
            on, x, y = data[i]
            slope = y * (weights[on] @ x + constant) - 1
            now = min(max(held[i] - slope / curve[i], 0.0), s.cost)
            step = (now - held[i]) * y
            if step:
                weights[on] += step * x
                constant += step
                held[i] = now
                worst = max(worst, abs(step) * curve[i])
        if worst < s.tolerance:
            break
    return weights, constant


def logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve with the least weighted log loss, by Newton steps; targets are
    smoothed by a row of each class, so that the curve stays finite where classes do not overlap."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        t = a * z + b
        return float((weight * (np.logaddexp(0, t) - target * t)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -700, 700)))
        g, h = weight * (p - target), weight * p * (1 - p)
        gradient = np.array([(g * z).sum(), g.sum()])
        second = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step, size, here = np.linalg.solve(second, gradient), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > here:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if size * np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", settings: ClassifierSettings = ClassifierSettings()) -> QualityModel:
    """Train on documents that ``labels`` marks 1 (good) or 0."""
    s = settings
    rows, counts = training_rows(docs, labels, key, text, label_key, label, s)
    n = [sum(y == v for _, y in rows) for v in (0, 1)]
    nothing = QualityModel(np.zeros(s.size), np.zeros(s.size), settings=s)
    if not min(n):
        nothing.offset = float(np.log((n[1] + 1) / (n[0] + 1)) if sum(n) else 0.0)
        return nothing
    apart = {v: [r for r in rows if r[1] == v] for v in (0, 1)}
    kept_out = [r for v in (0, 1) for r in apart[v][::5]] if min(n) >= 25 else rows
    train = [r for v in (0, 1) for i, r in enumerate(apart[v]) if i % 5] if min(n) >= 25 else rows
    scale = ratios(train, s)
    weights, constant = descend(train, scale, s)
    model = QualityModel(weights * scale, scale * scale, constant, settings=s)
    z, y = np.array([model.margin(on) for on, _ in kept_out]), np.array([y for _, y in kept_out])
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    model.slope, model.offset = logistic(z, y, weight)
    return model


def rate(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and score (0 to 1, higher: label 1 likelier) of every row."""
    kept = docs.select(*keep, F.col(text).alias("text_"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes if n != "text_"), "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers a bucket

    def run(batches):
        for batch in batches:
            own = pa.schema([*(batch.schema.field(n) for n in keep), ("score", pa.float64())])
            yield from by_text(iter([batch]), "text_", lambda t: (shared.value.score(t),), own, keep)

    return kept.mapInArrow(run, schema)
