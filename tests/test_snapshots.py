"""Indexed snapshots and the parse store: what is read and parsed, and that results stay the same."""

import json

import pytest
from pyspark.sql import functions as F

from pageloom import CrawlConfig, crawl_site
from pageloom.functions import urls
from pageloom.operators import parse
from pageloom.operators.parse import parse_pages
from pageloom.sources.indexed import IndexedSnapshot, SnapshotReader, netloc, write_snapshot
from pageloom.sources.journal import JournalMismatch
from pageloom.sources.parsed import ParseStore
from pageloom.sources.snapshots import PAGES_SCHEMA, SEEDS_SCHEMA

HOSTS = ("a.example", "a.example.org", "b.example", "c.example:80")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def many(spark):
    """400 pages on four hosts, with copies, nulls and unusual URLs."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("id") % 4 + 1).cast("int"))
    html = F.concat(F.lit("<h1>T"), F.col("id") % 50, F.lit("</h1><a href='/x/"), F.col("id"), F.lit("'>é</a>"))
    url = F.concat(F.lit("https://"), host, F.lit("/x/"), F.col("id"))
    pages = spark.range(400).select(F.col("id").alias("page_id"), url.alias("url"), F.when(F.col("id") % 37 != 5, html).alias("html"), F.when(F.col("id") % 9 == 0, 503).cast("int").alias("status"))
    odd = [(900, "https://a.example/x/4", "<p>copy", None), (901, None, "<p>no url", None), (902, "no host", "<p>", 200), (903, " https://b.example/x\n/2?q#f", "", None)]
    return pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string, status int")).repartition(5).cache()


@pytest.fixture(scope="module")
def snapshot(spark, many, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snapshot"))
    write_snapshot(many, folder, file_bytes=900)
    return IndexedSnapshot(spark, folder)


def pages_of(frame):
    return rows(frame.select("page_id", "url", "html", "status"))


def test_every_page_comes_back(snapshot, many):
    assert pages_of(snapshot.all()) == pages_of(many)
    with_host = {(r.url, r.host) for r in snapshot.all().where("url IS NOT NULL").collect()}
    assert with_host == {(r.url, r.host) for r in many.where("url IS NOT NULL").select("url", urls.netloc(F.col("url")).alias("host")).collect()}


@pytest.mark.parametrize(
    "condition", ["url = 'https://a.example/x/4'", "url IN ('https://b.example/x/2', 'https://a.example/x/8', 'none')", "host = 'a.example'", "host IN ('b.example', '')", "url = 'no host' AND host = ''", "url = 'https://a.example/x/4' AND host = 'b.example'", "page_id < 20 AND host = 'b.example'", "url IS NULL", "status = 503"]
)
def test_filters(snapshot, many, condition):
    named = many.withColumn("host", urls.netloc(F.col("url")))
    assert pages_of(snapshot.all().where(condition)) == pages_of(named.where(condition))


def test_only_index_files_that_can_hold_them_are_planned(snapshot):
    from pyspark.sql.datasource import EqualTo, In

    def planned(*filters):
        reader = SnapshotReader(snapshot.folder)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [p.name for p in reader.partitions() if p.name]

    everything = planned()
    assert len(everything) > 6
    assert len(planned(EqualTo(("url",), "https://a.example/x/4"))) <= 2  # its copy may lie in the next one
    assert 1 < len(planned(In(("host",), ("c.example:80",)))) < len(everything) / 2
    assert planned(EqualTo(("url",), "https://zzz.example/")) == []


def test_pushed_filters_reach_the_source(spark, snapshot):
    parts = lambda frame: frame.rdd.getNumPartitions()
    assert parts(snapshot.all().where("url = 'https://b.example/x/2' AND page_id >= 0")) == 1
    assert 1 < parts(snapshot.all().where("host IN ('b.example')")) < parts(snapshot.all()) / 2


def junk_but(spark, snapshot, keep):
    """Overwrite every byte of the data files outside the ranges of the URLs in ``keep``."""
    from pathlib import Path

    wanted = snapshot.index().where(F.col("url").isin(*keep) & (F.col("offset") >= 0)).collect()
    for path in Path(snapshot.folder).rglob("*.html"):
        data, clean = path.read_bytes(), bytearray(b"\xff" * path.stat().st_size)
        for r in wanted:
            if r.file.endswith(path.name):
                clean[r.offset : r.offset + r.length] = data[r.offset : r.offset + r.length]
        path.write_bytes(clean)


def test_a_shallow_crawl_reads_its_seeds_alone(spark, many, tmp_path):
    write_snapshot(many, str(tmp_path))
    snapshot = IndexedSnapshot(spark, str(tmp_path))
    keep = [f"https://{HOSTS[i % 4]}/x/{i}" for i in range(3, 103)]
    seeds = spark.createDataFrame([(f"c{i}", u) for i, u in enumerate(keep)] + [("gone", "https://a.example/gone")], SEEDS_SCHEMA)
    plain = crawl_site(many, seeds, 0)
    junk_but(spark, snapshot, keep)
    crawl = crawl_site(snapshot, seeds, 0)
    assert rows(crawl.visited) == rows(plain.visited) and rows(crawl.nodes) == rows(plain.nodes)


@pytest.mark.parametrize("depth,settings", [(2, {}), (1, {"only_base_hosts": False}), (3, {"prefix": "site"})], ids=str)
def test_crawls_of_a_snapshot(spark, site_pages, tmp_path, depth, settings):
    from small_site import SITE

    write_snapshot(site_pages, str(tmp_path))
    seeds = spark.createDataFrame([("c", SITE + "docs/"), ("d", SITE + "blog/")], SEEDS_SCHEMA)
    config = CrawlConfig(links_from="raw", **settings)
    plain, indexed = (crawl_site(p, seeds, depth, config) for p in (site_pages, IndexedSnapshot(spark, str(tmp_path))))
    assert rows(indexed.visited) == rows(plain.visited) and rows(indexed.nodes) == rows(plain.nodes)


def test_a_journal_knows_the_snapshot(spark, site_pages, site_seeds, tmp_path):
    write_snapshot(site_pages, str(tmp_path / "s"))
    journal = str(tmp_path / "j")
    crawl_site(IndexedSnapshot(spark, str(tmp_path / "s")), site_seeds, 1, journal=journal)
    assert crawl_site(IndexedSnapshot(spark, str(tmp_path / "s")), site_seeds, 1, journal=journal).scratch.reused
    write_snapshot(site_pages, str(tmp_path / "s"))
    with pytest.raises(JournalMismatch):
        crawl_site(IndexedSnapshot(spark, str(tmp_path / "s")), site_seeds, 1, journal=journal)


def test_no_snapshot_and_an_empty_one(spark, many, tmp_path):
    with pytest.raises(FileNotFoundError):
        IndexedSnapshot(spark, str(tmp_path / "none"))
    write_snapshot(many.limit(0), str(tmp_path / "empty"))
    empty = IndexedSnapshot(spark, str(tmp_path / "empty"))
    assert empty.all().isEmpty() and empty.of_urls(many.select("url")).isEmpty()


def test_hosts_like_the_column_function(spark):
    texts = ["https://a/b", "//h?x", "mailto:x@y", "a:b//c", " \thttp://h\n.x:8/#", "no", "", "http://[::1]/", "1a://x", "HTTP://UP/"]
    frame = spark.createDataFrame([(t,) for t in texts], "u string").select("u", urls.netloc(F.col("u")).alias("h"))
    assert {r.u: r.h for r in frame.collect()} == {t: netloc(t) for t in texts}


# --- parse store ----------------------------------------------------------------------------


def counted(monkeypatch, spark):
    """Count pages that are parsed, in whatever process."""
    total, original = spark.sparkContext.accumulator(0), parse._read

    def read(reader, html):
        total.add(html is not None)
        return original(reader, html)

    monkeypatch.setattr(parse, "_read", read)
    return total


def test_copies_and_known_pages_are_parsed_once(spark, many, tmp_path, monkeypatch):
    config, total = CrawlConfig(links_from="raw"), counted(monkeypatch, spark)
    pages = many.unionByName(many).repartition(4)
    want = rows(parse_pages(pages, config))
    distinct = pages.where("html IS NOT NULL").select("html").distinct().count()
    store, before = ParseStore(spark, str(tmp_path)), total.value
    assert rows(store.parse(pages, config)) == want and store.parsed == distinct and total.value - before == distinct
    before = total.value
    assert rows(store.parse(pages, config)) == want and store.parsed == 0 and total.value == before
    more = pages.withColumn("html", F.when(F.col("page_id") == 8, "<h1>new</h1>").otherwise(F.col("html")))
    again = ParseStore(spark, str(tmp_path))
    assert rows(again.parse(more, config)) == rows(parse_pages(more, config)) and again.parsed == 1


def test_settings_have_their_own_records(spark, many, tmp_path):
    store = ParseStore(spark, str(tmp_path))
    for config in (CrawlConfig(), CrawlConfig(drop_tags=("h1",)), CrawlConfig(collapse_blanks=False), CrawlConfig(prefix="off")):
        assert rows(store.parse(many, config)) == rows(parse_pages(many, config))
    assert store.parsed == 0  # the last one differs in nothing that a page's record depends on


def test_runs_that_add_the_same_at_once(spark, many, tmp_path):
    config = CrawlConfig()
    a, b = ParseStore(spark, str(tmp_path)), ParseStore(spark, str(tmp_path))
    a.parse(many, config)
    b._add(a.records(config), config, 0)  # b had begun before a was done
    folder = next(tmp_path.iterdir())
    assert [run["alone"] for run in json.loads(next(folder.glob("manifest-*.json")).read_text())["runs"]] == [True, False]
    assert rows(b.parse(many, config)) == rows(parse_pages(many, config))


def test_crawls_with_a_store(spark, site_pages, site_seeds, tmp_path, monkeypatch):
    config, total = CrawlConfig(links_from="raw"), counted(monkeypatch, spark)
    plain = crawl_site(site_pages, site_seeds, 2, config)
    first = crawl_site(site_pages, site_seeds, 2, config, parse_store=str(tmp_path))
    before = total.value
    second = crawl_site(site_pages, site_seeds, 3, config, parse_store=str(tmp_path))
    assert total.value == before
    assert rows(first.visited) == rows(plain.visited) and rows(first.nodes) == rows(plain.nodes)
    assert second.visited.count() >= first.visited.count()


def test_a_store_with_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], PAGES_SCHEMA)
    assert ParseStore(spark, str(tmp_path)).parse(none, CrawlConfig()).isEmpty()
