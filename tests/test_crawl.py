"""Traversal of the fixture site: levels, parents, order, failures, skew, repeats."""

import pytest
from pyspark.sql import functions as F

from small_site import PAGES, SITE
from pageloom import CrawlConfig, crawl_site, menu_config
from pageloom.operators import crawl as cr
from pageloom.operators import tree as tr
from pageloom.plans.site import SeedError
from pageloom.sources.snapshots import PAGES_SCHEMA, SEEDS_SCHEMA


def short(url):
    return None if url is None else url.replace(SITE, "")


def visited_rows(crawl):
    rows = crawl.visited.collect()
    return {short(r["url"]): (r["level"], short(r["parent_url"]), r["scraped"]) for r in rows}


@pytest.mark.parametrize(
    "links_from,expected",
    [("cleaned", [(1, 1), (4, 3), (6, 5), (7, 5)]), ("raw", [(1, 1), (5, 4), (7, 6), (9, 7)])],
)
def test_page_counts_per_depth(site_pages, site_seeds, links_from, expected):
    for depth, counts in enumerate(expected):
        crawl = crawl_site(site_pages, site_seeds, depth, CrawlConfig(links_from=links_from))
        row = crawl.summary.first()
        assert (row["visited"], row["scraped"]) == counts
        assert crawl.visited.agg(F.max("level")).first()[0] <= depth


@pytest.fixture(scope="module")
def deep(site_pages, site_seeds):
    return crawl_site(site_pages, site_seeds, 2)


def test_levels_parents_and_failures(deep):
    assert visited_rows(deep) == {
        "docs/": (0, None, True),
        "docs/api/ref": (1, "docs/", True),
        "docs/guide/": (1, "docs/", True),
        "docs/missing": (1, "docs/", False),
        "docs/api/ref/deep/er": (2, "docs/api/ref", True),
        "docs/guide/intro": (2, "docs/guide/", True),
    }
    failures = deep.failures.collect()
    assert [(r["pages"], r["error"][:19]) for r in failures] == [(1, "Failed to fetch URL")]


def test_preorder_titles_and_text(deep):
    rows = [(short(r["url"]), r["title"], r["text"]) for r in tr.preorder(deep.nodes).collect()]
    assert rows == [
        ("docs/", "Docs Home", "Home tag Docs Home GRSXTBMEHello\nworld"),
        ("docs/api/ref", "", "D\nRéf & more \U0001f600\nend"),
        ("docs/api/ref/deep/er", "Deep", "Deepme"),
        ("docs/guide/", "Guide", "GuideUpIRead ref or q."),
        ("docs/guide/intro", "Intro", "Intro OneTwoThree"),
    ]


def test_levels_and_links_found(deep):
    levels = [tuple(r)[1:] for r in deep.levels.orderBy("level").collect()]
    assert levels == [(0, 1, 1, 1), (1, 3, 2, 4), (2, 2, 2, 6)]
    found = {(short(r["src_url"]), r["depth_left"]): r["links"] for r in deep.links_found.collect()}
    assert found == {("docs/", 2): 3, ("docs/guide/", 1): 1, ("docs/api/ref", 1): 1}


def test_known_pages_are_skipped(spark, site_pages, site_seeds):
    known = spark.createDataFrame([("c", SITE + "docs/api/ref")], SEEDS_SCHEMA)
    crawl = crawl_site(site_pages, site_seeds, 3, known=known)
    assert set(visited_rows(crawl)) == {"docs/", "docs/guide/", "docs/missing", "docs/guide/intro"}
    again = crawl_site(site_pages, site_seeds, 3, known=crawl.visited)
    assert again.visited.isEmpty()


def test_seed_with_other_base(spark, site_pages):
    seeds = spark.createDataFrame(
        [("c", SITE + "docs/guide/", SITE + "docs/")], "crawl_id string, url string, base_url string"
    )
    crawl = crawl_site(site_pages, seeds, 1)
    assert set(visited_rows(crawl)) == {"docs/guide/", "docs/", "docs/guide/intro", "docs/api/ref"}


def test_invalid_and_failed_seeds(spark, site_pages):
    seeds = spark.createDataFrame(
        [("bad", "not-a-url"), ("gone", SITE + "none"), ("ok", SITE + "docs/legal")], SEEDS_SCHEMA
    )
    crawl = crawl_site(site_pages, seeds, 1)
    errors = {r["crawl_id"]: r["error"] for r in crawl.failures.collect()}
    assert errors == {"bad": "Invalid URL provided", "gone": "Failed to fetch URL: no page stored"}
    assert {r["crawl_id"] for r in crawl.visited.collect()} == {"gone", "ok"}
    with pytest.raises(SeedError):
        crawl_site(site_pages, seeds, 0, strict=True)


def test_status_timeouts_and_rejected_markup(spark):
    rows = [
        (1, SITE, '<a href="/a">a</a><a href="/b">b</a><a href="/c">c</a>', 200, False),
        (2, SITE + "a", "<h1>A</h1>", 503, False),
        (3, SITE + "b", "<h1>B</h1>", 200, True),
        (4, SITE + "c", "<![bad[x]]>", 200, False),
    ]
    pages = spark.createDataFrame(
        rows, "page_id long, url string, html string, status int, timed_out boolean"
    )
    seeds = spark.createDataFrame([("c", SITE)], SEEDS_SCHEMA)
    crawl = crawl_site(pages, seeds, 1)
    errors = {short(r["url"]): r["error"] for r in crawl.visited.collect()}
    assert errors.pop("c").startswith("Page markup rejected")
    assert errors == {
        "": None,
        "a": "Failed to fetch URL (HTTP 503)",
        "b": "Request timed out after 60 seconds",
    }


def test_menu_profile_takes_every_selector(site_pages, site_seeds):
    crawl = crawl_site(site_pages, site_seeds, 1, menu_config())
    # No excluded paths and no fallback: the search page counts, external links do not.
    assert set(visited_rows(crawl)) == {
        "docs/", "docs/guide/", "docs/api/ref", "docs/search", "docs/missing",
    }


def test_hot_urls_and_partitions_do_not_change_results(spark, site_pages):
    seeds = spark.createDataFrame([(f"c{i}", SITE + "docs/") for i in range(40)], SEEDS_SCHEMA)
    plain = crawl_site(site_pages, seeds, 3, CrawlConfig(links_from="raw"))
    salted = crawl_site(site_pages, seeds, 3, CrawlConfig(links_from="raw", hot_rows=10))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        other = crawl_site(site_pages, seeds, 3, CrawlConfig(links_from="raw", buckets=5))
        rows = [sorted(map(tuple, c.visited.collect()), key=str) for c in (plain, salted, other)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows[0]) == 40 * 9
    assert rows[0] == rows[1] == rows[2]
    nodes = [sorted(map(tuple, c.nodes.collect()), key=str) for c in (plain, salted)]
    assert nodes[0] == nodes[1]


def test_repeated_pages_count_once(spark, site_pages, site_seeds):
    copies = site_pages.unionByName(
        site_pages.where(F.col("url").endswith("docs/guide/"))
        .crossJoin(spark.range(500))
        .select((F.col("id") + 100).alias("page_id"), "url", F.lit("<h1>Late copy</h1>").alias("html"))
    )
    crawl = crawl_site(copies, site_seeds, 2)
    titles = {short(r["url"]): r["title"] for r in crawl.nodes.collect()}
    assert titles["docs/guide/"] == "Guide"
    assert len(titles) == 5


def test_a_base_without_a_host_keeps_pages_of_every_host(spark):
    rows = [(1, "https://a.example/", '<a href="https://b.example/x">b</a>'), (2, "https://b.example/x", "<h1>B</h1>")]
    pages = spark.createDataFrame(rows, PAGES_SCHEMA)
    seeds = spark.createDataFrame([("c", "https://a.example/", "")], "crawl_id string, url string, base_url string")
    settings = dict(menu_selectors=("a",), priority_selectors=(), prefix="off")
    for only in (True, False):
        crawl = crawl_site(pages, seeds, 1, CrawlConfig(only_base_hosts=only, **settings))
        found = {(r["url"], r["scraped"]) for r in crawl.visited.collect()}
        assert found == {("https://a.example/", True), ("https://b.example/x", True)}


def test_buckets_are_single_files(spark, site_pages, site_seeds, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        scratch = cr.Scratch(spark)
        for buckets in (6, 7, 12):
            config = CrawlConfig(buckets=buckets)
            graph = cr.page_graph(site_pages, cr.seed_rows(site_seeds), config, scratch)
            assert 1 <= len(graph.links.inputFiles()) <= buckets
            edges = site_pages.select(F.col("url").alias("src_url"), "url")
            graph = cr.edge_graph(edges, site_pages.select("url"), config, scratch)
            assert 1 <= len(graph.fetched.inputFiles()) <= buckets
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_source_is_found_however_small_its_file_is(spark):
    edges = spark.range(300_000).select(F.lit("https://e/r").alias("src_url"), F.lit("https://e/r/1").alias("url"))
    graph = cr.edge_graph(edges, edges.select("url").distinct(), CrawlConfig(), cr.Scratch(spark))
    assert graph.heavy is not None and graph.heavy.count() == 300_000


def test_copies_with_tied_ids_give_one_title(spark, site_seeds):
    rows = [(1, SITE + "docs/", f"<h1>Copy {i}</h1>") for i in range(8)]
    titles = set()
    for order in (rows, rows[::-1]):
        for partitions in (1, 3, 8):
            pages = spark.createDataFrame(order, PAGES_SCHEMA).repartition(partitions)
            titles |= {r["title"] for r in crawl_site(pages, site_seeds, 0).nodes.collect()}
    assert len(titles) == 1


def test_heavy_sources_of_an_edge_graph(spark):
    edges = spark.createDataFrame(
        [("https://e/r", f"https://e/r/{i}") for i in range(50)]
        + [(f"https://e/r/{i}", "https://e/r") for i in range(50)]
        + [("https://e/r/7", "https://e/r/7/x")],
        "src_url string, url string",
    )
    fetched = edges.select("url").distinct()
    seeds = spark.createDataFrame([("c", "https://e/r")], SEEDS_SCHEMA)
    results = []
    for hot in (10, 1000):
        config = CrawlConfig(hot_rows=hot)
        scratch = cr.Scratch(spark)
        graph = cr.edge_graph(edges, fetched, config, scratch)
        assert (graph.heavy is not None) == (hot == 10)
        visited = cr.traverse(cr.seed_rows(seeds), graph, 2, config, scratch)
        results.append(sorted((r["url"], r["level"], r["parent_url"]) for r in visited.collect()))
    assert results[0] == results[1]
    assert len(results[0]) == 52
    assert ("https://e/r/7/x", 2, "https://e/r/7") in results[0]


def test_traversal_invariants(spark, site_pages):
    seeds = spark.createDataFrame([(p, SITE + p) for p in PAGES], SEEDS_SCHEMA)
    visited = crawl_site(site_pages, seeds, 3, CrawlConfig(prefix="off", links_from="raw")).visited
    rows = {(r["crawl_id"], r["url"]): r for r in visited.collect()}
    assert len(rows) == visited.count()
    for row in rows.values():
        assert row["level"] <= 3 and len(row["path"]) == row["level"] + 1
        if row["level"]:
            parent = rows[row["crawl_id"], row["parent_url"]]
            assert parent["scraped"] and parent["level"] == row["level"] - 1
            assert parent["path"] == row["path"][:-1]


def test_empty_pages_schema(spark, site_seeds):
    crawl = crawl_site(spark.createDataFrame([], PAGES_SCHEMA), site_seeds, 1)
    assert [r["scraped"] for r in crawl.visited.collect()] == [False]
    assert crawl.nodes.isEmpty()


def test_a_crawl_without_text(spark, site_pages, site_seeds):
    plain, narrow = (crawl_site(site_pages, site_seeds, 2, text=text) for text in (True, False))
    for name in ("visited", "summary", "levels", "failures", "links_found"):
        assert sorted(map(str, getattr(narrow, name).collect())) == sorted(map(str, getattr(plain, name).collect()))
    assert "text" not in narrow.graph.fetched.columns and narrow.graph.pages is None
    with pytest.raises(ValueError, match="without text"):
        narrow.nodes  # noqa: B018


def test_edges_are_written_plain(spark):
    edges = spark.createDataFrame([(SITE, SITE + "a"), (SITE, SITE + "b")], "src_url string, url string")
    scratch = cr.Scratch(spark)
    graph = cr.edge_graph(edges, edges.select("url").distinct(), CrawlConfig(), scratch, by_url=False)
    assert sorted(map(tuple, graph.links.collect())) == [(SITE, [SITE + "a"]), (SITE, [SITE + "b"])]
    assert spark.read.parquet(f"{scratch.folder}/edges_1").dtypes == [("url", "string"), ("link", "string")]


def test_dictionaries_are_hashed_where_they_fit(spark, monkeypatch):
    from pageloom.operators import numbered as nb
    from pageloom.sources import scratch as sc

    edges = spark.createDataFrame([(f"{SITE}p{n}", f"{SITE}p{n * 7 % 40}") for n in range(40)], "src_url string, url string")
    seeds = cr.seed_rows(spark.createDataFrame([("c", SITE + "p1")], "crawl_id string, url string"))
    config = CrawlConfig(prefix="off", excluded_paths=())
    plans, write = [], sc.Scratch.write_bucketed

    def noted(self, df, label, *rest):
        if label == "neighbours":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, label, *rest)

    monkeypatch.setattr(sc.Scratch, "write_bucketed", noted)

    def neighbours():
        scratch = cr.Scratch(spark)
        graph = cr.edge_graph(edges, edges.select("url"), config, scratch, by_url=False)
        found = nb.number(graph.links, graph.heavy, seeds, config, scratch)
        return sorted(map(tuple, found.neighbours.selectExpr("id", "size(links)").collect()))

    found = [neighbours()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found.append(neighbours())
        monkeypatch.setattr(sc, "HASHED_BYTES", 0)
        found.append(neighbours())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] == found[2]
    assert ["ShuffledHashJoin" in plan for plan in plans] == [False, True, False]
    assert "SortMergeJoin" not in plans[1]
