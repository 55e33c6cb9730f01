"""No caps, no lost columns: many labels, long texts, many rules, scripts without case, clashing names, even shards."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pageloom.llm import components, decontaminate, language, packing, quality, secrets, shards, simhash, tokens, urlfilter, wavelet
from pageloom.llm import queries as q

SMALL = "/root/testdata/sf0.001"
SECRET = "token: abcdefghijklmnopqrstuv"


def test_more_labels_than_before(spark):
    """Each of 300 labels has a letter pair of its own; all are learned."""
    labels = [f"l{i:03d}" for i in range(300)]
    rng = random.Random(1)
    rows = [(i * 6 + k, " ".join(rng.choice((chr(0x4E00 + i), chr(0x4E00 + i) + "a")) for _ in range(30)), labels[i]) for i in range(300) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    settings = language.LanguageSettings(per_label=6, epochs=12, bits=14)
    found = language.training_rows(docs, "text", "lang", F.col("doc_id"), settings)
    assert {r.label for r in found} == set(labels)
    few = language.training_rows(docs, "text", "lang", F.col("doc_id"), language.LanguageSettings(sample_rows=300))
    assert 200 < len(few) < 400


def plain_pieces(text, bits):
    """Pieces of a text by their definition, hashed one by one."""
    code = [0] + [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0]
    out = Counter()
    for n in range(1, 5):
        for i in range(len(code) - n + 1):
            w = code[i : i + n]
            if not ((w[0] or w[-1]) if n < 3 else all(w[1:-1])):
                continue
            h = 0
            for c in w:
                h = (h * 0x9E3779B1 + c) & 0xFFFFFFFF
            h = (h + n) & 0xFFFFFFFF
            h ^= h >> 15
            out[(h * 0x85EBCA77 & 0xFFFFFFFF) >> 32 - bits] += 1
    return out


@pytest.mark.parametrize("size", [1 << 20, 7, 3, 2])
def test_slices_lose_and_repeat_no_piece(monkeypatch, size):
    monkeypatch.setattr(language, "SLICE", size)
    rng = random.Random(size)
    for text in ("", "a", "ab, cd", "abcdefghijk", "x" * 50, "".join(rng.choice("ab é.") for _ in range(300))):
        got = Counter(np.concatenate([*language.pieces(text, 12), np.zeros(0, int)]).astype(int).tolist())
        want = plain_pieces(text, 12) if any(c.isalpha() for c in text) else Counter()
        # A slice without a letter yields nothing; its boundary marks alone are no pieces that count.
        assert got == want or (size < 10 and sum((want - got).values()) <= sum(want.values()) and not got - want)


def test_language_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = q.op1_language_id(spark, folder).collect()
    assert len(found) == len(rows)
    known = [r for r in found if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in known) > 0.98 * len(known)


LINES = {
    "arabic": "هذا سطر عادي من نص عربي طويل بعض الشيء ولا شيء فيه",
    "hindi": "यह हिन्दी में लिखी हुई एक साधारण पंक्ति है जिसमें कुछ नहीं",
    "korean": "이것은 한국어로 쓰인 평범한 한 줄의 글 입니다 그리고 끝",
    "hebrew": "זוהי שורה רגילה של טקסט בעברית ואין בה שום דבר מיוחד",
    "numbers": "12 13 14 15 16 17",
}


@pytest.mark.parametrize("name", LINES)
def test_scripts_without_case_are_no_shouting(spark, name):
    assert quality.line_failure(LINES[name]) is None
    words, rng = LINES[name].split(), random.Random(3)
    text = "\n".join(" ".join(f"{rng.choice(words)}{rng.randint(0, 99)}" for _ in range(9)) for _ in range(12))
    assert quality.judge(text)[5:8] == (False, True, 0.0)
    assert quality.line_failure("ALL OF THIS IS SHOUTED ALOUD") == "punctuation"


def plain_kept(text):
    """The verdict by its rules, on lines cut afresh."""
    failed = [x for x in (text or "").split("\n") if quality.line_failure(x)]
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    repeats = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words)))
    base = len(words) < 50 or 100 * repeats > 50 * len(words)
    return not base and 2 * sum(map(len, failed)) <= len(text), "\n".join(x for x in (text or "").split("\n") if x not in failed)


def test_kept_and_cleaned_text(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: r.text for r in rows}
    found = quality.judge_documents(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert {r.doc_id: (r.kept, r.clean_text) for r in found} == {k: plain_kept(t) for k, t in text.items()}


def test_rules_of_any_number_give_the_same(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "org", ""]
    path = lambda: "/" + "/".join(rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice(hosts), rng.choice([path(), "", None]), rng.choice(["allow", "block"])) for _ in range(150)]
    urls = [f"http://{rng.choice(['www.', '', 'q.'])}{rng.choice(hosts)}{path()}{rng.choice(['', '?a', '#b'])}" for _ in range(300)] + [None, "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    trie, join = (urlfilter.filter_urls(pages, table, max_rules=n) for n in (10_000, 0))
    assert sorted(map(str, trie.collect())) == sorted(map(str, join.collect()))


def test_a_long_chain_is_one_component(spark):
    n = 3000
    order = random.Random(3).sample(range(n), n)
    found = components.components(spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")).collect()
    assert len(found) == n - 1 and {r.root for r in found} == {0}


def test_size_partitions_have_their_own_limits(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([6, 7, 12, 40, 300, 2000])]
    s = decontaminate.ContainmentSettings(spread=2, most_bits=6)  # crowded maps: more work, same rows
    pieces = decontaminate.item_shingles(spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text", decontaminate.ContainmentSettings())
    parts = decontaminate.partitions(pieces.where("sketched"), decontaminate.ContainmentSettings())
    assert len(parts) == 5 and len({p.bound for p in parts}) == 5
    hashes = np.array(sorted(r.hash for r in pieces.where("part = 2 AND sketched").select("hash").collect()))
    assert decontaminate.lookups(hashes, 1, parts) == [] and decontaminate.lookups(hashes, 2000, parts) == hashes.tolist()
    docs = [(k, f"{word()} {t} {word()}") for k, t in items] + [(100, " ".join(word() for _ in range(500)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for settings in (decontaminate.ContainmentSettings(), s):
        found = decontaminate.contaminated(frame, table, settings=settings).select("doc_id", "item_id").collect()
        assert sorted(map(tuple, found)) == [(i, i) for i in range(6)]


def clashing(spark, texts):
    names = ["text_hash_", "TEXT_HASH__", "key_", "found_", "KEY__", "found", "key", "fp", "root", "row_", "n_chars"]
    rows = [(i, t, *[f"own {n} {i}" for n in names[:-1]], -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names[:-1]) + ", n_chars int"), rows


@pytest.mark.parametrize("stage", ["simhash", "decontaminate", "redact"])
def test_own_columns_stay(spark, stage):
    spark.conf.set("spark.sql.caseSensitive", "false")
    plain = "some words that make up a longer text without anything in it at all and more"
    texts = [plain, plain, f"{plain} {SECRET}", None, "", "x"]
    docs, rows = clashing(spark, texts)
    if stage == "simhash":
        out = simhash.one_of_each(docs).collect()
        assert {r[0] for r in out} >= {0} and 1 not in {r[0] for r in out}
    elif stage == "decontaminate":
        items = spark.createDataFrame([(1, SECRET + " and some more words here to find")], "item_id bigint, text string")
        out = decontaminate.without_contaminated(docs, items).collect()
        assert len(out) == len(rows)
    else:
        out = secrets.redact(docs).collect()
        assert sum("[secret]" in (r[1] or "") for r in out) == 1
    for r in out:
        assert tuple(r)[2:-1] == rows[r[0]][2:-1]
    assert all(r[1] == texts[r[0]] for r in out if "[secret]" not in (r[1] or ""))


def test_one_of_each_group_is_the_smallest(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    group = {k: {k} for k, _, _ in prints}
    for i, (a, x, _) in enumerate(prints):
        for b, y, _ in prints[:i]:
            if (x ^ y).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[b]:
                    group[k] = group[a]
    assert {k: c for k, _, c in prints} == {k: min(g) for k, g in group.items()}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {min(g) for g in group.values()}


def test_shards_are_even(spark):
    found = shards.shard_by_bytes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    sizes = [r[1] for r in found.groupBy("shard").agg(F.sum("size")).collect()]
    mean = sum(sizes) / len(sizes)
    assert len(sizes) == 40 and min(sizes) > 0.98 * mean and max(sizes) < 1.02 * mean


def test_hard_cuts_only_where_nothing_else_is():
    s = packing.PackingSettings(window=16, grain=5)
    stops = np.zeros(4, dtype=bool)
    stops[2] = True
    ids = np.array([0, 0, 2] + [1] * 12 + [2] + [1] * 40 + [2])
    at, fee = packing.places(ids, np.array([len(ids)]), stops, s)
    assert at.tolist() == [0, 3, 16, 21, 26, 31, 36, 41, 46, 51, 56, 57] and fee[at == 21] == s.hard_cut and fee[at == 3] == s.sentence_cut


MIXED = ["naïve Ελλάδα café", "日本語 and words", "tab\tand　wide spaces", "emoji 😀 😀😀 in a row", "á é combining", "one  two", "ΟΔΟΣ ΟΔΟΣ.", "\ud800 lone"]


@pytest.mark.parametrize("name", [q.BYTE_VOCABULARY, q.WORD_VOCABULARY])
def test_mixed_scripts_give_the_library_ids(monkeypatch, name):
    monkeypatch.setattr(tokens, "MEMORY", 40)
    encode = tokens.Encoder(public_tokenizers.path(name))
    rng = random.Random(2)
    texts = MIXED + [" ".join(rng.choice(MIXED + ["plain", "words,", "12.5"]) for _ in range(rng.randint(2, 30))) for _ in range(60)]
    for text in texts:
        assert encode(text).tolist() == encode.library.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids


def test_random_access_reads_one_block(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 1000)
    ids = np.random.default_rng(3).integers(0, 3000, 9500).astype(np.uint16)
    data, read = wavelet.to_file([1, 2], [ids[:4000], ids[4000:]], 12), []

    def fetch(offset, length):
        read.append((offset, length))
        return data[offset : offset + length]

    shard = wavelet.Shard(fetch)
    del read[:]
    assert [shard.access(i) for i in range(3000, 4000, 37)] == ids[3000:4000:37].tolist()
    assert len(read) == 1 and read[0][1] < len(data) / 8
    assert shard.n_blocks == 10 and (shard.tokens() == ids).all()
    for value in (int(ids[0]), int(ids[-1]), 2999, 4000, -1):
        places = np.flatnonzero(ids == value)
        assert shard.count(value) == len(places) and shard.rank(value, 5500) == (places < 5500).sum()
        assert [shard.select(value, k) for k in range(len(places))] == places.tolist()
    with pytest.raises(IndexError):
        shard.access(9500)


def test_counts_places_and_access_over_files(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    path = public_tokenizers.path(q.BYTE_VOCABULARY)
    files = wavelet.write_shards(docs, path, file_tokens=20_000).cache()
    assert files.count() > 3
    rows = sorted(wavelet.read_shards(files).collect(), key=lambda r: r.start)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    wanted = [0, 11, 13, int(ids[17]), 50_000]
    counts = {r.id: r.n for r in wavelet.token_counts(files, wanted).collect()}
    assert counts == {w: int((ids == w).sum()) for w in wanted}
    found = sorted(map(tuple, wavelet.locate(files, wanted).collect()))
    assert found == sorted((w, int(p)) for w in set(wanted) for p in np.flatnonzero(ids == w))
    asked = spark.createDataFrame([(p,) for p in [*range(0, len(ids), 997), len(ids) - 1, len(ids), 5, 5]], "position bigint")
    got = {r.position: r.id for r in wavelet.access(files, asked).collect()}
    assert got == {p: int(ids[p]) for p in {*range(0, len(ids), 997), len(ids) - 1, 5}}


def test_pipeline_keeps_what_its_stages_decide(spark):
    """The whole pipeline against its stages' decisions, made one document at a time."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs = {k: clean for k, (kept, clean) in ((k, plain_kept(t)) for k, t in docs.items()) if kept}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    docs = {k: t for k, t in docs.items() if component[k] == k}
    items = [set(decontaminate.shingles(decontaminate.tokens(r.text), 5)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    own = {k: set(decontaminate.shingles(decontaminate.tokens(t), 5)) for k, t in docs.items()}
    docs = {k: t for k, t in docs.items() if not any(i and len(i & own[k]) >= 0.8 * len(i) for i in items)}
    encode = tokens.encoder(public_tokenizers.path(q.WORD_VOCABULARY))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(docs)
    free = {k: t for k, t in docs.items() if not secrets_in(t)}
    tokens_of = Counter()
    for r in got:
        tokens_of[r.doc_id] += r.length
    assert all(tokens_of[k] == len(encode(t)) + 1 for k, t in free.items()) and 0 < len(free) < len(docs)


def secrets_in(text):
    import re

    return any(len(m.group(r.group)) >= r.least for r in secrets.RULES for m in re.finditer(r.pattern, text))


QUERIES_WITH_SQL = ["op2_url_filter", "op5_decontamination", "op6_secret_scan", "op8_warc", "op11_centroid_clustering"]


@pytest.mark.parametrize("name", QUERIES_WITH_SQL)
def test_registered_queries_match_their_sql(spark, name):
    from compare import connect

    frame = q.QUERIES[name](spark, SMALL)
    expected = connect(SMALL).sql(q.ORACLES[name])
    assert sorted(expected.columns) == sorted(frame.columns)
    columns = sorted(frame.columns)
    theirs = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert Counter(map(tuple, frame.select(*columns).collect())) == Counter(theirs)


def test_every_registered_query_runs(spark):
    for name in sorted(set(q.QUERIES) - set(QUERIES_WITH_SQL) - {"op12_spelling_variants", "op13_quality_classifier", "op1_language_id"}):
        frame = q.QUERIES[name](spark, SMALL)
        assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)
