"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; runs of letters are words and everything else is one boundary
mark. All pieces of one to four characters, boundary marks at their ends included, are
hashed to buckets. The mean of the buckets' embeddings goes through a linear softmax.
Both layers are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows; a temperature and a rejection threshold are fitted on rows kept out of
the training. Since the mean is linear, embedding and output layer are multiplied into
one score per bucket and language before prediction.

Defined results: a null text or one without a letter gets ``und`` and score 0. Without
any labelled row every text does. Texts of any length are read whole, a million
characters at a time, with overlaps, so that no piece is lost or counted twice. Rows are judged one by
one, so ties and repeated rows do not matter; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import by_text

UNKNOWN = "und"
SLICE = 1 << 20
LONGEST = 4  # characters of a piece
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class LanguageSettings:
    per_label: int = 600  # expected training rows of each label
    sample_rows: int = 4096  # expected training rows in all; with many labels each gets an equal share
    bits: int = 15  # 2**bits buckets
    dims: int = 16
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7
    precision: float = 0.995  # wanted among texts that are not rejected


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  # one row per bucket, one column per label
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    settings: LanguageSettings = field(default_factory=LanguageSettings)

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.scores[ids].mean(axis=0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, calibrated probability, and whether it is too low to be relied on."""
        total, n = np.zeros(len(self.labels)), 0
        for ids in pieces(text, self.settings.bits):
            total += self.scores[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        if not n or not self.labels:
            return UNKNOWN, 0.0, True
        p = softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold)


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    return _letters


def pieces(text: str | None, bits: int):
    """Bucket numbers of all pieces of a text, an array for each slice of it."""
    before = np.zeros(1, dtype=np.uint32)  # the boundary mark in front of the text
    for start in range(0, len(text or ""), SLICE):
        raw = text[start : start + SLICE].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, dtype="<u4")
        after = [0] if start + SLICE >= len(text) else []
        code = np.concatenate([before, np.where(letters()[points], points, 0), after]).astype(np.uint32)
        on = code != 0
        if on.any():
            yield hashed(code, on, bits, len(before) if start else 0)
        before = code[-LONGEST + 1 :]


def hashed(code: np.ndarray, on: np.ndarray, bits: int, known: int = 0) -> np.ndarray:
    """Buckets of the pieces that end behind the first ``known`` points, which an earlier slice had."""
    found = []
    hash_ = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        size = len(code) - n + 1
        hash_ = hash_[:size] * np.uint32(0x9E3779B1) + code[n - 1 :]
        if n < 3:
            valid = on[:size] | on[n - 1 :]
        else:
            valid = on[1 : size + 1]
            for k in range(2, n - 1):
                valid = valid & on[k : size + k]
        valid[: max(0, known - n + 1)] = False
        h = hash_[valid] + np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        found.append(h >> np.uint32(32 - bits))
    return np.concatenate(found)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def training_rows(docs: DataFrame, text: str, label: str, key: Column, settings: LanguageSettings) -> list:
    """Piece counts of a sample with about ``per_label`` rows of each label and ``sample_rows`` in all, the
    same in every run.

    Only buckets and their counts leave the executors, at most 2**bits of each a row.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(label).count().collect()  # one a label
    if not counts:
        return []
    each = min(settings.per_label, settings.sample_rows / len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, each / r[1]))])
    draw = F.pmod(F.xxhash64(key, F.lit(settings.seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < share[F.col(label)]).select(F.col(label).alias("label"), F.col(text).alias("text"), draw.alias("draw"))
    schema = pa.schema([("label", pa.string()), ("draw", pa.float64()), ("ids", pa.binary()), ("n", pa.binary())])
    bits = settings.bits

    def count(text_):
        every = list(pieces(text_, bits))
        ids, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.array([]), np.array([]))
        return ids.astype("<u4").tobytes(), n.astype("<f4").tobytes()

    rows = sample.mapInArrow(lambda b: by_text(b, "text", count, schema, ("label", "draw")), "label string, draw double, ids binary, n binary")
    return sorted(rows.where(F.length("ids") > 0).collect(), key=lambda r: (r.draw, r.label, r.ids))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: Column | None = None, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Train on the rows of ``docs`` that have a label. ``key`` only decides which rows are sampled."""
    rows = training_rows(docs, text, label, F.col("doc_id") if key is None else key, settings)
    labels = sorted({r.label for r in rows})
    k, rng = len(labels), np.random.default_rng(settings.seed)
    table = rng.uniform(-1, 1, (1 << settings.bits, settings.dims)) / settings.dims
    out, bias = np.zeros((settings.dims, k)), np.zeros(k)
    data = []
    for r in rows:
        n = np.frombuffer(r.n, "<f4").astype(np.float64)
        data.append((np.frombuffer(r.ids, "<u4"), n / n.sum(), labels.index(r.label)))
    kept_out = data[::5] if len(data) >= 50 else []
    train = [x for i, x in enumerate(data) if i % 5] if kept_out else data
    steps = max(1, settings.epochs * len(train))
    for step, at in enumerate(np.concatenate([rng.permutation(len(train)) for _ in range(settings.epochs)]) if train else []):
        ids, share, y = train[at]
        rate = settings.rate * (1 - step / steps)
        vectors = table[ids]
        mean = share @ vectors
        error = softmax(mean @ out + bias)
        error[y] -= 1
        back = out @ error
        out -= rate * np.outer(mean, error)
        bias -= 0.1 * rate * error
        # A bucket holds a small share of a text; the square root keeps its steps from vanishing.
        table[ids] -= rate * np.sqrt(share)[:, None] * back
    model = LanguageModel(labels, (table @ out).astype(np.float32), bias, settings=settings)
    return calibrated(model, kept_out)


def calibrated(model: LanguageModel, rows: list) -> LanguageModel:
    """Set temperature (least log loss) and threshold (wanted precision, and all but a
    two-hundredth of the right ones accepted at most)."""
    if not rows:
        return model
    z = np.array([share @ model.scores[ids] + model.bias for ids, share, _ in rows])
    y = np.array([r[2] for r in rows])
    at = np.arange(len(y))
    losses = {t: -np.log(softmax(z / t)[at, y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / (at + 1) >= model.settings.precision
    precise = top[order][np.flatnonzero(good)[-1]] if good.any() else 1.0
    usual = np.quantile(top[right], 0.005) if right.any() else 1.0
    model.threshold = float(usual if good.all() else precise)
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, then lang_pred, score and rejected of every row."""
    kept = docs.select(*keep, F.col(text).alias("text_"))
    fields = "lang_pred string, score double, rejected boolean"
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes if n != "text_"), fields])
    made = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for batch in batches:
            own = pa.schema([batch.schema.field(n) for n in keep] + list(made))
            yield from by_text(iter([batch]), "text_", model.predict, own, keep)

    return kept.mapInArrow(run, schema)
