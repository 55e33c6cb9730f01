"""Centroid clustering, spelling variants and the quality classifier against brute force and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import nbsvm, orchard, variants
from pageloom.llm import queries as q

SMALL = "/root/testdata/sf0.001"


# --- centroid clustering ------------------------------------------------------------------


def brute_clusters(rows, s):
    kept = [(k, [math.floor(Fraction(x) * s.scale) for x in v]) for k, v in rows if v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) for x in v)]

    def draw(key):
        return (key is None, "" if key is None else hashlib.sha256(f"{s.start}{key}".encode()).hexdigest())

    centroids = [v for _, v in sorted(kept, key=lambda r: (draw(r[0]), r[1]))[: s.k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(s.rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if groups[i] else c for i, c in enumerate(centroids)]
    found = [(k, *nearest(v)[::-1]) for k, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 1 << 63 else None
    return Counter((k, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), sha[c]) for k, c, d in found)


def vectors(seed, n=90, dims=3, scale=4.0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(rng.choice([-1, 0, 1]) * scale, 0.4), 2) for _ in range(dims)]) for i in range(n)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, [0.5] * dims), (None, None), (200, [1.0] * (dims + 1)), (201, [1.0] * (dims - 1) + [None])]
    rows += [(202, [1.0] * (dims - 1) + [float("nan")]), (203, [float("inf")] + [0.0] * (dims - 1)), (204, [])]
    return rows + [(300 + i, [0.0] * dims) for i in range(12)]  # ties


@pytest.mark.parametrize(
    "settings,scale",
    [
        (orchard.ClusterSettings(k=5, rounds=4, dims=3), 4.0),
        (orchard.ClusterSettings(k=40, rounds=3, dims=3, scale=2), 1.0),  # many ties and equal centroids
        (orchard.ClusterSettings(k=1, rounds=2, dims=3), 4.0),
        (orchard.ClusterSettings(k=6, rounds=3, dims=3), 3e15),  # beyond 64-bit distances
        (orchard.ClusterSettings(k=300, rounds=1, dims=3, scale=8), 1.0),  # more than there are vectors
    ],
    ids=str,
)
def test_clusters(spark, settings, scale):
    rows = vectors(settings.k, scale=scale)
    frame = spark.createDataFrame([(k, v, "x", 7) for k, v in rows], "vec_id bigint, embedding array<double>, cluster string, v_ int").repartition(4)
    got = orchard.cluster(frame, settings=settings)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, settings)


def test_orchard_compares_few_centroids_and_finds_the_nearest():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-40, 40, (64, 2)) * 100
    x = centroids[rng.integers(0, 64, 500)] + rng.integers(-9, 10, (500, 2))
    now, best, compared = orchard.Orchard([tuple(c) for c in centroids.tolist()]).nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (now == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert compared < 0.7 * every.size


def test_no_vectors(spark):
    assert orchard.cluster(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).isEmpty()


def test_clusters_of_the_registered_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert Counter(map(tuple, q.op11_centroid_clustering(spark, SMALL).collect())) == brute_clusters(rows, orchard.ClusterSettings())


# --- spelling variants --------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, s, near=None):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if s.damage and h % s.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= s.min_points:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= s.min_n}
    if near is None:
        near = {w: [x for x in words if near_words(w, x)] for w in words}
    else:
        near = near(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= s.ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (c, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, c in words.items()}


def by_deletion(words):
    """Near words through common remainders: the same pairs as by comparing all, but fast."""
    groups, near = defaultdict(set), {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            groups[i, w[:i] + w[i + 1 :]].add(w)
            if (rest := w[:i] + w[i + 1 :]) in near:
                near[w].add(rest), near[rest].add(w)
    for group in groups.values():
        for w in group:
            near[w] |= group - {w}
    return near


def odd_texts(seed):
    """Few letters, so that there are many near words and anagrams; chains of forms; long and odd words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀéx") for _ in range(rng.randint(6, 9))) for _ in range(260)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(25)]
    chain = [("grandest", 2400), ("grandesti", 240), ("grandestio", 24), ("grandestion", 2)]
    rows += [(100 + i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    wide = "ab" * 60
    rows += [(200, f"{wide} {wide}"), (201, f"{wide}c {wide}c"), (202, f"a{wide[2:]} a{wide[2:]}"), (203, "x" * 3000 + " " + "x" * 3000)]
    rows += [(None, "ABCDEFG abcdefg ÀBCDEFG Àbcdefg àbcdefg àbcdefg"), (7, None), (8, ""), (9, "日本語 abcdefgh-abcdefgh×abcdefgh÷ \ud83d"[:-1])]
    return rows + [(100, rows[0][1])] * 2


@pytest.mark.parametrize(
    "settings",
    [
        variants.VariantSettings(),
        variants.VariantSettings(block=7, visitors=11, batch=3, leaf=1),
        variants.VariantSettings(min_points=1, min_n=1, damage=3, ratio=2, block=50, leaf=4),
        variants.VariantSettings(min_points=6, damage=0, most_levels=3),
    ],
    ids=str,
)
def test_variants(spark, settings):
    rows = odd_texts(4)
    frame = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    got = variants.variants(frame, settings=settings)
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()}
    assert got.count() == len(found) and found == brute_variants(rows, settings)


def test_a_chain_of_forms_has_one_root(spark):
    rows = [(k, t) for k, t in odd_texts(4) if k in (100, 101, 102, 103) and t and t.startswith("grand")]
    got = variants.variants(spark.createDataFrame(rows, "doc_id bigint, text string"), settings=variants.VariantSettings(damage=0))
    assert {r.word: r.root for r in got.collect()} == dict.fromkeys(("grandest", "grandesti", "grandestio", "grandestion"), "grandest")


def test_stretches_keep_words_whole(monkeypatch):
    monkeypatch.setattr(variants, "STRETCH", 50)
    text = " ".join("abcdefgh" + "xyz"[i % 3] * (i % 9) for i in range(300)) + "q" * 200
    assert "".join(variants.stretches(text)) == text
    s = variants.VariantSettings(damage=0)
    assert dict(variants.tally(1, text, s)) == Counter(w.encode() for w in text.split())


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id bigint, text string")
    assert variants.variants(docs).isEmpty() and variants.variants(docs.limit(0)).isEmpty()


def test_variants_of_the_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in q.op12_spelling_variants(spark, SMALL).collect()}
    assert got == brute_variants(rows, variants.VariantSettings(), by_deletion)


# --- quality classifier -------------------------------------------------------------------


def brute_indicators(text, s):
    raw, on = (text or "").encode("utf-8", "surrogatepass"), set()
    for n in (1, 2, 3):
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 0x9E3779B1 + b) & 0xFFFFFFFF
            h = (h + n) & 0xFFFFFFFF
            h ^= h >> 15
            on.add((h * 0x85EBCA77 & 0xFFFFFFFF) >> 32 - s.bits)
    words = raw.split()
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for i in range(len(words) - 3):
        on.add((1 << s.bits) + sum((words[i + a] == words[i + b]) << k for k, (a, b) in enumerate(pairs)))
    return on


def test_indicators(monkeypatch):
    s = nbsvm.ClassifierSettings(bits=12)
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a a", "x x x x", "é😀\ud800", " ".join(rng.choice(["ab", "c", "déf"]) for _ in range(400))]
    for text in texts:
        assert set(np.flatnonzero(nbsvm.indicators(text, s)).tolist()) == brute_indicators(text, s)
    whole = nbsvm.indicators(texts[-1], s)
    for size in (5, 64, 1000):
        monkeypatch.setattr(nbsvm, "SLICE", size)
        assert (nbsvm.indicators(texts[-1], s) == whole).all()


def test_dual_descent_reaches_the_optimum():
    """The primal objective of what dual coordinate descent finds is no larger than that of many small changes of it."""
    s, rng = nbsvm.ClassifierSettings(bits=4, epochs=500, tolerance=1e-9), np.random.default_rng(2)
    rows = [(np.flatnonzero(rng.random(s.size) < (0.3 if y else 0.5)), int(y)) for y in rng.random(60) < 0.5]
    scale = nbsvm.ratios(rows, s)
    weights, constant = nbsvm.descend(rows, scale, s)

    def objective(w, b):
        total = 0.5 * (w @ w + b * b)
        for on, y in rows:
            x = np.zeros(s.size)
            x[on] = scale[on]
            total += s.cost * max(0, 1 - (1 if y else -1) * (w @ (x / np.linalg.norm(x)) + b))
        return total

    least = objective(weights, constant)
    for size in (1e-3, 1e-2, 0.1, 1):
        for _ in range(50):
            assert objective(weights + size * rng.normal(size=s.size), constant + size * rng.normal()) >= least - 1e-6


def test_ratios():
    s = nbsvm.ClassifierSettings(bits=3)
    r = nbsvm.ratios([(np.array([0, 1]), 1), (np.array([1]), 1), (np.array([1, 2]), 0)], s)
    assert np.isclose(r[0], math.log((2 / 4) / (1 / 3))) and np.isclose(r[1], math.log((3 / 4) / (2 / 3))) and np.isclose(r[2], math.log((1 / 4) / (2 / 3)))


def marked(spark, n=400):
    rng = random.Random(8)

    def text(good):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        return " ".join(words) if good else " ".join(w + rng.choice(["!!", " |", "$$"]) for w in words)

    rows = [(i, text(i % 4), "e", 0.5, 1) for i in range(n)] + [(None, "x", "e", 0.5, 1), (n, None, "e", 0.5, 1), (n + 1, "", "e", 0.5, 1), (0, "again !!", "e", 0.5, 1)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, n, 2)] + [(None, 1, 0), (3, None, 0), (5, 7, 0), (9999, 0, 0), (2, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, label_ int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_classifier(spark):
    docs, labels = marked(spark)
    model = nbsvm.fit(docs, labels)
    got = nbsvm.rate(docs, model)
    assert got.columns == ["doc_id", "score"] and got.count() == docs.count()
    scores = {r.doc_id: r.score for r in got.where("doc_id < 400 AND doc_id <> 0").collect()}
    held_out = [i for i in range(1, 400, 2)]
    assert np.mean([(scores[i] >= 0.5) == (i % 4 > 0) for i in held_out]) > 0.98
    empty = {r.score for r in got.where("doc_id >= 400").collect()}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    again = nbsvm.fit(docs.repartition(5), labels)
    assert (again.weights == model.weights).all() and again.offset == model.offset


def test_classifier_with_one_class_or_none(spark):
    docs, labels = marked(spark, 40)
    for only, want in ((labels.where("quality = 1"), lambda x: 0.9 < x < 1), (labels.where("quality = 0"), lambda x: 0 < x < 0.2), (labels.limit(0), lambda x: x == 0.5)):
        model = nbsvm.fit(docs, only)
        assert want(model.score("some text")) and want(model.score(None))
    assert nbsvm.rate(docs.limit(0), model).isEmpty()


def test_sample_bound(spark):
    docs, labels = marked(spark)
    many = docs.unionByName(docs).unionByName(docs)
    s = nbsvm.ClassifierSettings(per_label=30)
    rows, counts = nbsvm.training_rows(many, labels, "doc_id", "text", "doc_id", "quality", s)
    assert len(rows) <= 60 and counts[1] + counts[0] == labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").distinct().count()


def test_registered_classifier_is_right_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = q.op13_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert [c for c in q.op13_quality_classifier(spark, folder).columns] == ["doc_id", "held_out", "score", "predicted"]
    right = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
