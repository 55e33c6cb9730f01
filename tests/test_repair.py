"""Repaired levels against a crawl from scratch after random changes."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom import CrawlConfig
from pageloom.operators import crawl as cr
from pageloom.operators.repair import repair
from pageloom.sources import scratch as sc
from pageloom.sources.scratch import Scratch

CONFIG = CrawlConfig(excluded_paths=(), prefix="off")
DEPTH = 3


def url(n):
    return f"https://h.example/{'d/' * (n % 3)}p{n}"


def tables(spark, pages):
    """Link rows of good pages, and the stored pages with their errors."""
    links = [(url(n), url(m)) for n, (error, out) in pages.items() if error is None for m in out]
    fetched = [(url(n), error) for n, (error, _) in pages.items()]
    return spark.createDataFrame(links, "src_url string, url string"), spark.createDataFrame(fetched, "url string, error string")


def crawled(spark, pages, seeds):
    links, fetched = tables(spark, pages)
    scratch = Scratch(spark)
    graph = cr.edge_graph(links, fetched, CONFIG, scratch)
    return cr.traverse(cr.seed_rows(seeds), graph, DEPTH, CONFIG, scratch)


def rows(frame):
    return sorted(map(tuple, frame.select("crawl_id", "url", "level", "parent_url", "path", "base_url", "scraped", "error").collect()), key=repr)


@pytest.mark.parametrize("seed,edits", [(1, 1), (4, 25), (5, 0)])
def test_equals_a_crawl_from_scratch(spark, seed, edits):
    rng = random.Random(seed)
    pages = {n: (None if rng.random() < 0.9 else "Failed to fetch URL (HTTP 404)", rng.sample(range(90), rng.randint(0, 4))) for n in range(80)}
    seeds = spark.createDataFrame([("a", url(0)), ("a", url(5)), ("b", url(1)), ("gone", url(300))], "crawl_id string, url string")
    before = crawled(spark, pages, seeds)
    after, changed = dict(pages), set()
    for _ in range(edits):
        n = rng.choice([*range(95), 0, 1])
        changed.add(n)
        kind = rng.random()
        if kind < 0.25 and n in after:
            del after[n]
        elif kind < 0.4:
            after[n] = ("Failed to fetch URL (HTTP 503)", [])
        else:
            after[n] = (None, rng.sample(range(95), rng.randint(0, 5)))
    links, fetched = tables(spark, after)
    fixed = repair(before, links, fetched, spark.createDataFrame([(url(n),) for n in changed], "url string"), DEPTH, CONFIG, Scratch(spark))
    scratch_rows = rows(crawled(spark, after, seeds))
    assert rows(fixed.visited) == scratch_rows
    if not edits:
        assert fixed.touched.agg(F.sum("looked_at"), F.sum("changed")).first()[0] in (None, 0)
    if edits == 1:
        assert (fixed.touched.agg(F.sum("looked_at")).first()[0] or 0) < len(scratch_rows) / 2


def test_a_chain_that_is_cut_and_joined(spark):
    chain = {n: (None, [n + 1]) for n in range(4)} | {4: (None, [])}
    seeds = spark.createDataFrame([("c", url(0))], "crawl_id string, url string")
    before = crawled(spark, chain, seeds)
    for after in ({**chain, 0: (None, [1, 3])}, {**chain, 0: ("Request timed out", [])}):
        links, fetched = tables(spark, after)
        changed = spark.createDataFrame([(url(n),) for n in after if after[n] != chain[n]], "url string")
        fixed = repair(before, links, fetched, changed, DEPTH, CONFIG, Scratch(spark))
        assert rows(fixed.visited) == rows(crawled(spark, after, seeds))


def test_links_are_read_once(spark):
    pages = {n: (None, [n + 1, n + 2]) for n in range(8)}
    seeds = spark.createDataFrame([("c", url(0))], "crawl_id string, url string")
    before = crawled(spark, pages, seeds)
    after = {**pages, 1: ("Request timed out", []), 2: (None, [5, 7])}
    links, fetched = tables(spark, after)
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    twice = links.unionByName(links)  # repeated links change nothing
    counted = spark.createDataFrame(twice.rdd.map(seen), links.schema)
    fixed = repair(before, counted, fetched, spark.createDataFrame([(url(1),), (url(2),)], "url string"), DEPTH, CONFIG, Scratch(spark))
    assert rows(fixed.visited) == rows(crawled(spark, after, seeds))
    assert fixed.touched.agg(F.sum("looked_at")).first()[0] > 0
    assert read.value == twice.count()


def test_what_does_not_fit_a_task_is_sorted(spark, monkeypatch):
    """Long URLs that are much alike take little space in files, and much in memory."""
    monkeypatch.setattr(sc, "HASHED_BYTES", 100_000)
    plans, write = [], Scratch.write

    def noted(self, df, label):
        if label in ("placed", "refreshed"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, label)

    def long(frame):
        return frame.select(*[F.concat(F.col(c), F.repeat(F.lit("/d"), 500)).alias(c) if "url" in c else c for c in frame.columns])

    pages = {n: (None, [n + 1, n + 2]) for n in range(300)}
    seeds = long(spark.createDataFrame([("c", url(0))], "crawl_id string, url string"))
    links, fetched = map(long, tables(spark, pages))
    changed = long(spark.createDataFrame([(url(1),)], "url string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Scratch(spark)
        before = cr.traverse(cr.seed_rows(seeds), cr.edge_graph(links, fetched, CONFIG, scratch), DEPTH, CONFIG, scratch)
        left, kept = links.join(changed.withColumnRenamed("url", "src_url"), "src_url", "left_anti"), fetched.join(changed, "url", "left_anti")
        monkeypatch.setattr(Scratch, "write", noted)
        fixed = repair(before, left, kept, changed, DEPTH, CONFIG, scratch)
        after = cr.traverse(cr.seed_rows(seeds), cr.edge_graph(left, kept, CONFIG, scratch), DEPTH, CONFIG, scratch)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(fixed.visited) == rows(after)
    joins = "\n".join(line for plan in plans for line in plan.split("\n") if "stored" in line and "Join" in line)
    assert plans and all("SortMergeJoin" in plan for plan in plans if "stored" in plan), joins
