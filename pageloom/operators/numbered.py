"""The traversal in whole numbers: URLs become ids once, and rounds shuffle longs alone.

The dictionary holds every URL a crawl may come to, in the order of host and URL. Since it is
range-partitioned and sorted, ids rise in that order. Each base puts two marks into the same
order, one before and one after all URLs that start with its prefix on its host. So the rules
that compare a link with its crawl's base become one test on whole numbers, ``lo < id < hi``.

Neighbour lists are sorted arrays of ids, bucketed by the source's id and written with
parquet's delta coding, so that lists of one site, whose ids lie close together, take few
bits an id. A round looks them up where they lie, keeps the ids inside the crawl's range and
reduces them to one row an id with the first parent.

What a crawl has visited is a table of bit words: one bit an id, 64 ids a row, built with
``bit_or`` and bucketed by crawl and word. A round's ids are tested against it where it lies:
the test is exact, older levels are never shuffled, and only the new level's words are merged
into it. Names return at the end: level by level, each visited page gets its URL, its status and
its path once. The status lies beside the URL in the dictionary, and of the level above only pages
that lead on are shuffled with their paths.

The links themselves meet the dictionary by 64-bit hashes of the URLs, so two longs a link are
shuffled and sorted. The dictionary holds the sources, too, and is searched for two URLs with one
hash; if there are any, the URLs themselves are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig
from pageloom.functions import urls
from pageloom.operators import links as lk
from pageloom.sources.scratch import Scratch, bucket_count, hashed, input_bytes
from pageloom.sources.snapshots import MISSING_PAGE

WORD_BITS = 6  # 64 ids a word
BEFORE, URL, AFTER = 0, 1, 2  # kinds of dictionary rows, in their order
DELTA_CODED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
VISITED = ["crawl", "word"]


@dataclass(frozen=True)
class NumberedGraph:
    """``urls(id, url, segments)``; ``ranges(place, prefix, lo, hi)``; ``neighbours(id, links)``,
    bucketed by id, with arrays of ``(id, segments)``; ``heavy(id, links)`` of sources with very many
    rows, or None."""

    urls: DataFrame
    ranges: DataFrame
    neighbours: DataFrame
    heavy: DataFrame | None
    buckets: int


def applies(seeds: DataFrame, config: CrawlConfig) -> bool:
    """Whether every crawl's links form one range: not so for a base without a host, which
    lets links of all hosts pass."""
    if not config.same_domain:
        return True
    return seeds.where(F.coalesce(urls.netloc(F.col("base_url")), F.lit("")) == "").isEmpty()


def _place(url: Column, config: CrawlConfig) -> Column:
    """First part of the dictionary's order."""
    return urls.netloc(url) if config.same_domain else F.lit("")


def short(url: Column) -> Column:
    """What stands for a URL in joins, as long as no two URLs of the dictionary share it."""
    return F.xxhash64(url)


def _joined_by(named: DataFrame):
    """``short``, or the URLs as they are where two of ``named(url)`` have one hash."""
    clashes = named.groupBy(short(F.col("url")).alias("short")).agg(F.count("*").alias("n")).where("n > 1")
    return short if clashes.isEmpty() else lambda url: url


def number(links: DataFrame, heavy: DataFrame | None, seeds: DataFrame, config: CrawlConfig, scratch: Scratch) -> NumberedGraph:
    """Number what ``links(url, links)`` and ``heavy`` lead to and from, and the seeds."""

    def pairs(table: DataFrame) -> DataFrame:
        rows = table.select("url", F.explode("links").alias("link")).where("url IS NOT NULL AND link IS NOT NULL")
        return rows if config.same_domain else rows.where(urls.is_valid_url(F.col("link")))

    wanted = seeds.select("url")
    for table in (links,) if heavy is None else (links, heavy):
        wanted = wanted.unionByName(pairs(table).select(F.col("link").alias("url"))).unionByName(table.select("url").where("url IS NOT NULL"))
    wanted = wanted.distinct()
    nothing = F.lit(None).cast("string")
    rows = wanted.select(_place(F.col("url"), config).alias("place"), F.col("url").cast("binary").alias("key"), F.lit(URL).alias("kind"), nothing.alias("prefix"))
    base, mark = F.col("base_url"), F.col("prefix").cast("binary")
    bases = seeds.select(_place(base, config).alias("place"), urls.base_prefix(base, config.prefix).alias("prefix")).distinct()
    marks = F.array(F.struct(mark.alias("key"), F.lit(BEFORE).alias("kind")), F.struct(F.concat(mark, F.lit(b"\xff")).alias("key"), F.lit(AFTER).alias("kind")))
    rows = rows.unionByName(bases.select("place", F.inline(marks), "prefix"))
    # Range partitioning reads its input twice, here from the shuffle that made the URLs distinct.
    ordered = scratch.write_ordered(rows, "urls", ["place", "key", "kind"])
    url = F.col("key").cast("string")
    segments = urls.segment_count(url) if config.sort_by_depth else F.lit(0)
    named = ordered.where(F.col("kind") == URL).select(F.col("ord").alias("id"), url.alias("url"), segments.alias("segments"))
    low = ordered.where(F.col("kind") == BEFORE).select("place", "prefix", F.col("ord").alias("lo"))
    high = ordered.where(F.col("kind") == AFTER).select("place", "prefix", F.col("ord").alias("hi"))
    by = _joined_by(named)

    def numbered(table: DataFrame) -> DataFrame:
        target = hashed(named.select(by(F.col("url")).alias("link"), F.col("id").alias("link_id"), "segments"))
        source = hashed(named.select(by(F.col("url")).alias("source"), "id"))
        rows = pairs(table).select(by(F.col("url")).alias("source"), by(F.col("link")).alias("link"))
        met = rows.join(target, "link").select("source", F.struct(F.col("link_id").alias("id"), "segments").alias("link"))
        return met.join(source, "source")

    buckets = config.buckets or bucket_count(links.sparkSession, input_bytes(links))
    # By source, as the rows lie after the join.
    lists = numbered(links).groupBy("source", "id").agg(F.sort_array(F.collect_set("link")).alias("links"))
    lists = lists.select("id", "links").repartition(buckets, "id")
    stored = scratch.write_bucketed(lists, "neighbours", "id", buckets, DELTA_CODED)
    apart = None
    if heavy is not None:
        apart = scratch.write(numbered(heavy).select("id", F.array("link").alias("links")), "heavy_neighbours")
    return NumberedGraph(named, low.join(high, ["place", "prefix"]), stored, apart, buckets)


def with_status(graph: NumberedGraph, fetched: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, url, error`` of the dictionary's URLs, bucketed by id; a page that is not in ``fetched(url, error)``
    is missing."""
    stored = hashed(fetched.select("url", "error", F.lit(True).alias("stored")))
    error = F.when(F.col("stored").isNull(), F.lit(MISSING_PAGE)).otherwise(F.col("error"))
    names = graph.urls.select("id", "url").join(stored, "url", "left").select("id", "url", error.alias("error"))
    return scratch.write_bucketed(names.repartition(graph.buckets, "id"), "names", "id", graph.buckets)


def start(seeds: DataFrame, known: DataFrame | None, graph: NumberedGraph, config: CrawlConfig, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers of the crawls, the first level, and what earlier runs visited as bit words.

    ``seeds`` are valid and hold none of the ``known`` pages.
    """
    crawls = scratch.write_ordered(seeds.select("crawl_id").distinct(), "crawls", ["crawl_id"]).withColumnRenamed("ord", "crawl")
    base = F.col("base_url")
    placed = seeds.withColumns({"place": _place(base, config), "prefix": urls.base_prefix(base, config.prefix)})
    rows = placed.join(crawls, "crawl_id").join(graph.ranges, ["place", "prefix"]).join(graph.urls, "url")
    first = rows.select("crawl", "id", F.lit(0).alias("level"), "segments", F.lit(None).cast("bigint").alias("parent"), "lo", "hi")
    first = _write_level(first, "crawl", scratch)
    bits = words(first)
    if known is not None:
        old = known.join(crawls, "crawl_id").join(graph.urls, "url").select("crawl", "id")
        bits = words(old.unionByName(first.select("crawl", "id")))
    return crawls, first, scratch.write_bucketed(bits, "visited_words", VISITED, graph.buckets)


def _write_level(rows: DataFrame, order: str, scratch: Scratch) -> DataFrame:
    """Write a level in the order of the tree: by crawl or parent, deep paths first, then by URL."""
    kept = rows.withColumn("shallow", -F.col("segments")).drop("segments")
    return scratch.write_ordered(kept, "level", [order, "shallow", "id"], ("shallow",))


def words(rows: DataFrame) -> DataFrame:
    """Bit words of (crawl, id) rows."""
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    return rows.groupBy("crawl", F.shiftright("id", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def unseen(rows: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows whose bit is not set; ``visited`` is read where it lies."""
    met = rows.withColumn("word", F.shiftright("id", WORD_BITS)).join(visited, VISITED, "left")
    return met.where("bits IS NULL OR (shiftrightunsigned(bits, CAST(id & 63 AS INT)) & 1) = 0").drop("word", "bits")


def merged(visited: DataFrame, level: DataFrame) -> DataFrame:
    """Words with those of a new level; only the new ones are shuffled."""
    new = words(level).withColumnRenamed("bits", "more")
    zero = F.lit(0).cast("bigint")
    both = F.coalesce("bits", zero).bitwiseOR(F.coalesce("more", zero))
    return visited.join(new, VISITED, "full").select(*VISITED, both.alias("bits"))


def next_level(level: DataFrame, depth: int, visited: DataFrame, graph: NumberedGraph, lookup) -> DataFrame:
    """One row per new page of each crawl, below the first page that links to it. ``lookup`` joins
    with a bucketed table whatever the requests' skew."""
    rows = level.select("crawl", "id", "ord", "lo", "hi")
    found = lookup(rows, graph.neighbours)
    if graph.heavy is not None:
        # Neither side is bucketed here, so skewed partitions can be split at run time.
        found = found.unionByName(rows.join(graph.heavy, "id"))
    links = found.select("crawl", "ord", "lo", "hi", F.explode("links").alias("link")).where("link.id > lo AND link.id < hi")
    first = links.groupBy("crawl", F.col("link.id").alias("id")).agg(
        F.min("ord").alias("parent"),
        F.first("link.segments").alias("segments"),
        F.min_by("lo", "ord").alias("lo"),
        F.min_by("hi", "ord").alias("hi"),
    )
    return unseen(first, visited).withColumn("level", F.lit(depth))


def named_levels(levels: list[DataFrame], crawls: DataFrame, seeds: DataFrame, names: DataFrame, config: CrawlConfig, scratch: Scratch, lookup) -> list[DataFrame]:
    """Levels with ``crawl_id, url, level, parent_url, path, base_url, parent_ord, ord, scraped, error``, from the top down."""
    key = F.array(urls.sort_key(F.col("url"), config.sort_by_depth))
    kept = [F.col("parent").alias("parent_ord"), "ord", F.col("error").isNull().alias("scraped"), "error", "leads"]
    out: list[DataFrame] = []
    for depth, level in enumerate(levels):
        rows = level.select("crawl", "id", "ord", "level", "parent")
        if depth + 1 < len(levels):
            parents = levels[depth + 1].select(F.col("parent").alias("ord")).distinct()
            rows = rows.join(parents.withColumn("leads", F.lit(True)), "ord", "left")
        else:
            rows = rows.withColumn("leads", F.lit(None).cast("boolean"))
        rows = lookup(rows, names, counted=level).drop("id")
        if not depth:
            bases = seeds.join(crawls, "crawl_id").select("crawl", "crawl_id", "url", "base_url")
            rows = rows.join(bases, ["crawl", "url"]).select("crawl_id", "url", "level", F.lit(None).cast("string").alias("parent_url"), key.alias("path"), "base_url", *kept)
        else:
            above = out[-1].where("leads").select(F.col("ord").alias("parent"), "crawl_id", F.col("url").alias("parent_url"), F.col("path").alias("above"), "base_url")
            rows = rows.join(above, "parent").select("crawl_id", "url", "level", "parent_url", F.concat("above", key).alias("path"), "base_url", *kept)
        out.append(scratch.write(rows, "named_level"))
    return [rows.drop("leads") for rows in out]


def walk(
    links: DataFrame, heavy: DataFrame | None, fetched: DataFrame, seeds: DataFrame, known: DataFrame | None, max_depth: int, config: CrawlConfig, scratch: Scratch, lookup
) -> list[DataFrame]:
    """Levels ``crawl_id, url, level, parent_url, path, base_url, parent_ord, ord, scraped, error`` of a traversal from ``seeds``
    (valid, one row a crawl and URL, without the ``known`` pages). ``fetched(url, error)`` has one row per stored page."""
    graph = number(links, heavy, seeds, config, scratch)
    names = with_status(graph, fetched, scratch)
    crawls, level, visited = start(seeds, known, graph, config, scratch)
    levels = [level]
    for depth in range(max_depth):
        level = _write_level(next_level(level, depth + 1, visited, graph, lookup), "parent", scratch)
        if level.isEmpty():
            break
        levels.append(level)
        if depth + 1 < max_depth:
            visited = scratch.write_bucketed(merged(visited, level), "visited_words", VISITED, graph.buckets)
    return named_levels(levels, crawls, seeds, names, config, scratch, lookup)
