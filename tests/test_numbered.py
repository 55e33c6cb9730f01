"""The traversal in whole numbers against the one that keeps URLs, its visited words, and journals."""

import json

import pytest
from pyspark.sql import functions as F

from pageloom import CrawlConfig, crawl_site, menu_config
from pageloom.operators import crawl as cr
from pageloom.operators import numbered as nb
from pageloom.operators import parse
from pageloom.plans import site
from pageloom.sources import scratch as sc
from pageloom.sources.journal import MANIFEST, Journal, JournalMismatch
from pageloom.sources.scratch import Scratch
from pageloom.sources.snapshots import PAGES_SCHEMA, SEEDS_SCHEMA
from small_site import PAGES, SITE

NUMBERED, PLAIN = {"numbered_from_depth": 0}, {"numbered_from_depth": 99}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def random_graph(spark, pages=120, links=900):
    """Pages on three hosts with links between them, from a hash of the row number."""
    host = F.array(*[F.lit(h) for h in ("https://a.example", "https://a.example.evil", "http://a.example")])

    def page(salt):
        number = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(pages))
        deep = F.when(number % 3 == 0, F.concat(F.lit("/d/"), number)).otherwise(F.concat(F.lit("/"), number))
        return F.concat(F.element_at(host, (number % 7 % 3 + 1).cast("int")), deep)

    return spark.range(links).select(page(1).alias("src_url"), page(2).alias("url"))


def traversed(spark, edges, seeds, depth, known=None, **settings):
    config = CrawlConfig(**settings)
    scratch = Scratch(spark)
    stored = edges.select("url").union(seeds.select("url")).distinct().where("crc32(url) % 5 <> 0")
    graph = cr.edge_graph(edges.join(stored.withColumnRenamed("url", "src_url"), "src_url"), stored, config, scratch)
    visited = cr.traverse(cr.seed_rows(seeds), graph, depth, config, scratch, known)
    return rows(visited)


@pytest.mark.parametrize(
    "settings",
    [
        {"prefix": "off"},
        {"prefix": "seed"},
        {"prefix": "off", "same_domain": False, "sort_by_depth": False},
        {"prefix": "site", "same_domain": False},
        {"prefix": "site", "hot_rows": 12},
        {"prefix": "off", "buckets": 3, "excluded_paths": ("/1",)},
    ],
    ids=str,
)
def test_numbers_and_urls_give_the_same_pages(spark, settings):
    edges = random_graph(spark)
    first = edges.select("url").distinct().orderBy(F.xxhash64("url")).limit(9).collect()
    seeds = [(f"c{i % 4}", r.url, None if i % 3 else "https://a.example") for i, r in enumerate(first)]
    seeds += [("root", "https://a.example", None), ("bad", "no-url", None)]
    seeds = spark.createDataFrame(seeds, "crawl_id string, url string, base_url string")
    known = spark.createDataFrame([("root", r.url) for r in first[:4]] + [("elsewhere", "https://z/")], SEEDS_SCHEMA)
    old = None if settings["prefix"] == "seed" else known
    plain = traversed(spark, edges, seeds, 4, old, **settings, **PLAIN)
    assert traversed(spark, edges, seeds, 4, old, **settings, **NUMBERED) == plain
    assert len(plain) > 10


def test_numbers_follow_pages(spark, site_pages):
    seeds = spark.createDataFrame([(p, SITE + p) for p in PAGES], SEEDS_SCHEMA)
    for config in (CrawlConfig(links_from="raw", prefix="off"), menu_config(links_from="raw", prefix="site")):
        crawls = [crawl_site(site_pages, seeds, 3, config.with_(**way)) for way in (NUMBERED, PLAIN)]
        assert rows(crawls[0].visited) == rows(crawls[1].visited)


def test_a_prefix_that_ends_inside_a_host_or_before_the_last_character(spark):
    last = "https://a.example/\U0010ffff\U0010ffff"
    edges = spark.createDataFrame(
        [("https://a.example/", x) for x in (last, "https://a.example.evil/", "https://a.example", "https://a.exampl")], "src_url string, url string"
    )
    for same_domain in (True, False):
        for base in ("https://a.example", "https://a.example/\U0010ffff"):
            seeds = spark.createDataFrame([("c", "https://a.example/", base)], "crawl_id string, url string, base_url string")
            found = [traversed(spark, edges, seeds, 2, same_domain=same_domain, prefix="seed", **way) for way in (NUMBERED, PLAIN)]
            assert found[0] == found[1]
            assert last in {r[1] for r in found[0]}


def test_a_base_without_a_host_keeps_urls(spark):
    seeds = spark.createDataFrame([("c", "https://a/", "")], "crawl_id string, url string, base_url string")
    assert not nb.applies(seeds, CrawlConfig())
    assert nb.applies(seeds, CrawlConfig(same_domain=False))


def test_empty_inputs(spark):
    edges = spark.createDataFrame([], "src_url string, url string")
    seeds = spark.createDataFrame([("c", "https://a/")], SEEDS_SCHEMA)
    assert [r[:3] for r in traversed(spark, edges, seeds, 3, **NUMBERED)] == [("c", "https://a/", 0)]
    assert traversed(spark, edges, seeds.limit(0), 3, **NUMBERED) == []


def test_older_levels_are_not_shuffled(spark):
    ids = spark.range(500).select((F.col("id") % 3).alias("crawl"), (F.col("id") * 37).alias("id"))
    scratch = Scratch(spark)
    visited = scratch.write_bucketed(nb.words(ids.where("id % 2 = 0")), "visited_words", nb.VISITED, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (nb.unseen(ids, visited), nb.merged(visited, ids.where("id % 2 = 1"))):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan
            # One shuffle places the new rows by crawl and word; their own grouping uses it too.
            assert plan.count("Exchange hashpartitioning(crawl") == 1
        assert rows(nb.unseen(ids, visited)) == rows(ids.where("id % 2 = 1"))
        both = nb.merged(visited, ids.where("id % 2 = 1"))
        assert rows(both) == rows(nb.words(ids))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def packed_rows(spark, rows=200_000):
    """Rows that take little space in files and about 100 MB in memory, as paths do."""
    path = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.concat(F.repeat(F.lit("https://a.example/d/"), 5), n.cast("string")))
    return spark.range(rows, numPartitions=4).select("id", path.alias("path"))


def join_of(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [name for name in ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin") if name in plan]


def test_rows_that_unpack_to_much_are_neither_hashed_nor_broadcast(spark, tmp_path):
    scratch = Scratch(spark)
    written = scratch.write(packed_rows(spark), "packed")
    spark.range(3_000_000).write.parquet(str(tmp_path / "others"))
    others = spark.read.parquet(str(tmp_path / "others"))
    assert sc.input_bytes(written) < 10 << 20 < sc.HASHED_BYTES < sc.held_bytes(written)
    assert join_of(others.join(written, "id")) == ["SortMergeJoin"]
    assert join_of(others.join(sc.hashed(written), "id")) == ["SortMergeJoin"]
    few = written.where("id % 200 = 0")
    assert join_of(others.join(scratch.write(few, "few"), "id")) == ["BroadcastHashJoin"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert join_of(others.join(sc.hashed(written), "id")) == ["SortMergeJoin"]
        assert join_of(others.join(sc.hashed(scratch.write(few, "few")), "id")) == ["ShuffledHashJoin"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_urls_with_one_hash_are_told_apart(spark, monkeypatch):
    edges = random_graph(spark).unionByName(spark.createDataFrame([(None, "https://a.example/1"), ("https://a.example/1", None)], "src_url string, url string"))
    first = edges.where("url IS NOT NULL").select("url").distinct().orderBy(F.xxhash64("url")).limit(4).collect()
    seeds = spark.createDataFrame([(f"c{i % 2}", r.url) for i, r in enumerate(first)], SEEDS_SCHEMA)
    plain = traversed(spark, edges, seeds, 4, prefix="off", **PLAIN)
    assert len(plain) > 10
    assert traversed(spark, edges, seeds, 4, prefix="off", **NUMBERED) == plain
    monkeypatch.setattr(nb, "short", lambda url: F.pmod(F.xxhash64(url), F.lit(20)))
    assert traversed(spark, edges, seeds, 4, prefix="off", **NUMBERED) == plain


def test_only_parents_are_shuffled_with_their_paths(spark, monkeypatch):
    edges = spark.createDataFrame(
        [("https://e/", f"https://e/{n}") for n in range(9)] + [(f"https://e/{n}", f"https://e/{n % 3}/x") for n in range(3, 6)], "src_url string, url string"
    )
    seeds = spark.createDataFrame([("c", "https://e/"), ("gone", "https://f/")], SEEDS_SCHEMA)
    written, write = [], Scratch.write

    def noted(self, df, label):
        written.extend([df] if label == "named_level" else [])
        return write(self, df, label)

    monkeypatch.setattr(Scratch, "write", noted)
    config, scratch = CrawlConfig(**NUMBERED), Scratch(spark)
    graph = cr.edge_graph(edges, edges.select(F.explode(F.array("src_url", "url")).alias("url")).distinct(), config, scratch, by_url=False)
    visited = cr.traverse(cr.seed_rows(seeds), graph, 2, config, scratch)
    assert [sorted(r.url for r in level.where("leads").collect()) for level in written] == [["https://e/"], ["https://e/3", "https://e/4", "https://e/5"], []]
    assert {r.url: r.scraped for r in visited.collect()} == {"https://f/": False, "https://e/": True} | {f"https://e/{n}": True for n in range(9)} | {f"https://e/{n}/x": True for n in range(3)}


# --- journals -----------------------------------------------------------------------------


@pytest.fixture
def stored_pages(spark, site_pages, tmp_path):
    site_pages.write.parquet(str(tmp_path / "pages"))
    return spark.read.schema(PAGES_SCHEMA).parquet(str(tmp_path / "pages"))


@pytest.mark.parametrize("way", [NUMBERED, PLAIN], ids=("numbers", "urls"))
def test_a_crawl_goes_on_where_it_stopped(spark, stored_pages, site_seeds, tmp_path, monkeypatch, way):
    config, folder = CrawlConfig(links_from="raw", **way), str(tmp_path / "journal")
    whole = rows(crawl_site(stored_pages, site_seeds, 4, config).visited)
    crawl_site(stored_pages, site_seeds, 2, config, journal=folder)
    first = json.loads((tmp_path / "journal" / MANIFEST).read_text())["tables"]
    (tmp_path / "journal" / "left_behind_77").mkdir()

    def no_parsing(*_):
        raise AssertionError("parsed again")

    monkeypatch.setattr(parse, "_read", no_parsing)
    again = crawl_site(stored_pages, site_seeds, 4, config, journal=folder)
    assert rows(again.visited) == whole
    assert not (tmp_path / "journal" / "left_behind_77").exists()
    walked = [t["name"] for t in first if t["name"].startswith(("level", "frontier", "pages", "neighbours", "urls"))]
    assert walked and set(walked) <= set(again.scratch.reused)
    monkeypatch.undo()
    assert rows(again.nodes) == rows(crawl_site(stored_pages, site_seeds, 4, config).nodes)


def test_a_crash_between_table_and_manifest(spark, stored_pages, site_seeds, tmp_path, monkeypatch):
    """Wherever a run stops, the next one ends with the same rows and no file that is not listed."""
    config, folder = CrawlConfig(links_from="raw", **NUMBERED), str(tmp_path / "journal")
    whole = rows(crawl_site(stored_pages, site_seeds, 2, config).visited)
    publish, left = Journal._publish, [0]

    def stops(self, name, buckets=None):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("stopped")
        publish(self, name, buckets)

    monkeypatch.setattr(Journal, "_publish", stops)
    for more in (1, 4, 3):
        left[0] = more
        with pytest.raises(RuntimeError, match="stopped"):
            crawl_site(stored_pages, site_seeds, 2, config, journal=folder)
    left[0] = 99
    crawl = crawl_site(stored_pages, site_seeds, 2, config, journal=folder)
    assert rows(crawl.visited) == whole
    listed = {t["name"] for t in json.loads((tmp_path / "journal" / MANIFEST).read_text())["tables"]}
    assert {p.name for p in (tmp_path / "journal").iterdir() if not p.name.startswith(".")} == listed | {MANIFEST}
    assert len(crawl.scratch.reused) == 8


def test_a_journal_of_other_settings_is_refused(spark, stored_pages, site_seeds, tmp_path):
    folder = str(tmp_path / "journal")
    crawl_site(stored_pages, site_seeds, 1, CrawlConfig(), journal=folder)
    others = spark.createDataFrame([("other", SITE + "docs/")], SEEDS_SCHEMA)
    for seeds, config in ((site_seeds, CrawlConfig(prefix="off")), (others, CrawlConfig())):
        with pytest.raises(JournalMismatch):
            crawl_site(stored_pages, seeds, 1, config, journal=folder)
    assert site.Journal is Journal
