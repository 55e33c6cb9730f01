"""Depth-bounded traversal of many sites at once, breadth first.

Each URL of a crawl gets its smallest level. Among the pages that link to it, the one
that comes first in the order of the tree becomes its parent, so results do not depend
on timing. A round is one plan: look up the frontier's links, keep those the rules
allow, reduce them to one row per URL, take away what is known, and write the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig
from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.operators import links as lk
from pageloom.operators import numbered as nb
from pageloom.operators.extract import heading, title
from pageloom.operators.parse import parse_pages
from pageloom.sources.scratch import Scratch, bucket_count, hashed, input_bytes
from pageloom.sources.snapshots import INVALID_URL, MISSING_PAGE, copy_order, fetch_error

KEY = ["crawl_id", "url"]


@dataclass(frozen=True)
class LinkGraph:
    """What a traversal reads, all keyed by ``url``.

    ``links(url, links)`` is bucketed by ``url``. ``heavy(url, links)`` holds the links of
    the few sources with very many rows, or is None. ``fetched(url, error)`` has one row
    per stored page; a null error means the page was scraped.
    """

    links: DataFrame
    fetched: DataFrame
    scratch: Scratch
    heavy: DataFrame | None = None
    pages: DataFrame | None = None


# --- hot keys -------------------------------------------------------------------------


def hot_keys(rows: DataFrame, config: CrawlConfig, scratch: Scratch, key: str = "url") -> DataFrame | None:
    """URLs (or ids) that occur in ``hot_rows`` rows or more, with as many ``salts`` as they hold
    times that number; None where there are none.

    They stay a table, however many there are, and nothing is collected.
    """
    if rows.count() < config.hot_rows:
        return None
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= config.hot_rows)
    hot = scratch.write(counts.select(key, F.ceil(F.col("n") / config.hot_rows).alias("salts")), "hot")
    return None if hot.isEmpty() else hot


def lookup(
    requests: DataFrame,
    table: DataFrame,
    config: CrawlConfig,
    scratch: Scratch,
    how: str = "inner",
    key: str = "url",
    spread: str = "crawl_id",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join requests with a table that is bucketed by ``key``, whatever the requests' skew.

    Requests for ordinary URLs meet the buckets where they lie. URLs that very many
    crawls request at once go apart, spread over salts. ``counted`` has the requests' keys where
    the requests themselves are costly to read twice.
    """
    hot = hot_keys(requests if counted is None else counted, config, scratch, key)
    if hot is None:
        return requests.join(table, key, how)
    cold = requests.join(hot, key, "left_anti").join(table, key, how)
    salted = requests.join(hot, key).withColumn("salt", F.pmod(F.xxhash64(spread), F.col("salts")))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))
    salted_table = table.join(hot, key).withColumn("salt", each).drop("salts")
    return cold.unionByName(salted.join(salted_table, [key, "salt"], how).drop("salt", "salts"))


# --- graphs ---------------------------------------------------------------------------


def page_graph(
    pages: DataFrame, seeds: DataFrame, config: CrawlConfig, scratch: Scratch, parse: Callable = parse_pages, text: bool = True
) -> LinkGraph:
    """Parse the pages the crawls can reach and write them bucketed by URL.

    One pass over the markup yields text, titles and links. Where links must stay on
    their base's host, pages of other hosts are left out before they are parsed, unless
    ``config.only_base_hosts`` is off. The result is the same either way. ``parse`` stands in
    for ``parse_pages``, as a parse store does. Without ``text`` only links and errors are kept,
    which is all that counts and the visited pages need.
    """
    buckets = config.buckets or bucket_count(pages.sparkSession, input_bytes(pages))
    if config.same_domain and config.only_base_hosts:
        pages = _on_base_hosts(pages, seeds, scratch)
    error = fetch_error(pages, config)
    order = copy_order(pages)
    fetched = pages.select(
        "url",
        order.alias("page_order"),
        error.alias("fetch_error"),
        F.when(error.isNull(), F.col("html")).alias("html"),
    )
    parsed = lk.with_page_links(parse(fetched, config), config)
    named = [tx.clean_text(F.col("raw_text")).alias("text"), heading(F.col("h1"), F.col("title_tag")).alias("heading")]
    record = F.struct(
        F.coalesce("fetch_error", "parse_error").alias("error"),
        *(named if text else []),
        F.filter("links", lambda u: lk.passes_page_rules(u, config)).alias("links"),
    )
    # A snapshot may store a URL many times. The first copy counts, and since copies are
    # reduced before the shuffle, a URL with very many of them does no harm.
    first = parsed.groupBy("url").agg(F.min_by(record, "page_order").alias("page"))
    stored = scratch.write_bucketed(first.select("url", "page.*"), "pages", "url", buckets)
    return LinkGraph(
        links=stored.where(F.col("error").isNull()).select("url", "links"),
        fetched=stored.select("url", "error"),
        scratch=scratch,
        pages=stored.where(F.col("error").isNull()).select("url", "text", "heading") if text else None,
    )


def _on_base_hosts(pages: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages of the hosts the crawls start from or stay on; Spark chooses how to join.

    A base without a host lets links of every host pass, so then all pages stay.
    """
    bases = seeds.select(F.explode(F.array("url", "base_url")).alias("url"))
    hosts = scratch.write(bases.select(urls.netloc(F.col("url")).alias("host")).distinct(), "hosts")
    if not hosts.where("host = ''").isEmpty():
        return pages
    return pages.withColumn("host", urls.netloc(F.col("url"))).join(hosts, "host", "left_semi").drop("host")


def edge_graph(
    edges: DataFrame, fetched: DataFrame, config: CrawlConfig, scratch: Scratch, by_url: bool = True
) -> LinkGraph:
    """Graph from link rows ``src_url, url`` and stored pages ``url[, error]``.

    A traversal that numbers URLs places the links by number itself; for it, ``by_url`` False
    leaves out placing them by URL.
    """
    if "error" not in fetched.columns:
        fetched = fetched.withColumn("error", F.lit(None).cast("string"))
    one_each = fetched.groupBy("url").agg(F.min("error").alias("error"))
    rows = edges.where(lk.passes_page_rules(F.col("url"), config)).select(F.col("src_url").alias("url"), F.col("url").alias("link"))
    # Written first: the rows are counted, then placed, and their plan runs only once. Plain
    # columns write in half the time of arrays of one link.
    rows = scratch.write(rows, "edges").select("url", F.array("link").alias("links"))
    buckets = config.buckets or bucket_count(edges.sparkSession, input_bytes(rows))
    hot = hot_keys(rows, config, scratch)
    heavy = None
    if hot is not None:
        heavy = scratch.write(rows.join(hot, "url", "left_semi"), "heavy_links")
        rows = rows.join(hot, "url", "left_anti")
    return LinkGraph(
        links=scratch.write_bucketed(rows.repartition(buckets, "url"), "links", "url", buckets) if by_url else rows,
        fetched=scratch.write_bucketed(one_each, "fetched", "url", buckets),
        scratch=scratch,
        heavy=heavy,
    )


# --- traversal ------------------------------------------------------------------------


def seed_rows(seeds: DataFrame) -> DataFrame:
    """Seeds with a ``base_url``; a seed is its crawl's base unless it names another."""
    base = F.coalesce("base_url", "url") if "base_url" in seeds.columns else F.col("url")
    return seeds.select("crawl_id", "url", base.alias("base_url"))


def rejected_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds that are refused before they count as visited."""
    return seeds.where(~urls.is_valid_url(F.col("url"))).select(
        "crawl_id", "url", F.lit(INVALID_URL).alias("error")
    )


def _starts(seeds: DataFrame, known: DataFrame | None) -> DataFrame:
    """Seeds to begin with: valid, once a crawl and URL, and not known."""
    start = seeds.where(urls.is_valid_url(F.col("url")))
    start = start.groupBy(*KEY).agg(F.min("base_url").alias("base_url"))
    return start if known is None else start.join(known, KEY, "left_anti")


def _first_frontier(start: DataFrame, config: CrawlConfig) -> DataFrame:
    return start.select(
        *KEY,
        F.lit(0).alias("level"),
        F.lit(None).cast("string").alias("parent_url"),
        _own_key(config).alias("path"),
        "base_url",
        F.lit(None).cast("bigint").alias("parent_ord"),
    )


def _links_of(frontier: DataFrame, graph: LinkGraph, config: CrawlConfig) -> DataFrame:
    """Frontier rows with the links of their scraped pages that pass every rule."""
    found = lookup(frontier.withColumn("base", lk.crawl_base(F.col("base_url"), config)), graph.links, config, graph.scratch)
    if graph.heavy is not None:
        # Neither side is bucketed here, so skewed partitions can be split at run time.
        heavy = frontier.join(graph.heavy, "url")
        found = found.unionByName(heavy.withColumn("base", lk.crawl_base(F.col("base_url"), config)))
    kept = [name for name in frontier.columns if name not in ("path", "parent_url", "base_url", "parent_ord")]
    exploded = found.select(*kept, "base", F.explode("links").alias("link"))
    return exploded.where(lk.passes_crawl_rules(F.col("link"), F.col("base"), config)).drop("base")


def _next_frontier(
    frontier: DataFrame, seen: DataFrame, graph: LinkGraph, config: CrawlConfig
) -> DataFrame:
    """One row per new URL of each crawl, below the first page that links to it.

    ``ord`` rises with the order of the tree within a level, so the first parent is a
    minimum over longs, which combines before the shuffle however often a URL is linked.
    """
    found = _links_of(frontier, graph, config)
    first = found.groupBy("crawl_id", F.col("link").alias("url")).agg(F.min("ord").alias("ord"))
    new = first.join(seen, KEY, "left_anti")
    parents = frontier.select(
        "ord",
        (F.col("level") + 1).alias("level"),
        F.col("url").alias("parent_url"),
        F.col("path").alias("parent_path"),
        "base_url",
    )
    return new.join(parents, "ord").select(
        *KEY,
        "level",
        "parent_url",
        F.concat("parent_path", _own_key(config)).alias("path"),
        "base_url",
        F.col("ord").alias("parent_ord"),
    )


def _own_key(config: CrawlConfig) -> Column:
    return F.array(urls.sort_key(F.col("url"), config.sort_by_depth))


def _write_frontier(found: DataFrame, order: str, scratch: Scratch) -> DataFrame:
    """Write a level in the order of the tree: by crawl or parent, then by own key.

    Parents are ordered already, so this sorts by a long and one string, not by paths.
    """
    keyed = found.withColumn("own_key", F.element_at("path", -1))
    return scratch.write_ordered(keyed, "frontier", [order, "own_key"], ("own_key",))


@dataclass(frozen=True)
class Traversal:
    """``visited`` has ``crawl_id, url, level, parent_url, path, base_url, scraped, error``. ``tree``
    has the scraped ones with ``ord``, a long that rises with the order of the tree within a
    level, and ``parent_ord``, that of the parent in the level above. ``depth`` is the last level."""

    visited: DataFrame
    tree: DataFrame
    depth: int


def traverse(
    seeds: DataFrame,
    graph: LinkGraph,
    max_depth: int,
    config: CrawlConfig,
    scratch: Scratch,
    known: DataFrame | None = None,
) -> DataFrame:
    """``visited`` of a traversal."""
    return traversal(seeds, graph, max_depth, config, scratch, known).visited


def traversal(
    seeds: DataFrame,
    graph: LinkGraph,
    max_depth: int,
    config: CrawlConfig,
    scratch: Scratch,
    known: DataFrame | None = None,
) -> Traversal:
    """Visit the pages that ``seeds`` lead to, level by level.

    ``known(crawl_id, url)`` holds pages that earlier runs visited; they are neither
    visited again nor expanded. A failed page stays visited but leads nowhere.
    """
    known = None if known is None else known.select(*KEY)
    if numbers_urls(seeds, max_depth, config):
        by_id = partial(lookup, config=config, scratch=scratch, key="id", spread="crawl")
        start = scratch.write(_starts(seeds, known), "starts")
        rounds = nb.walk(graph.links, graph.heavy, graph.fetched, start, known, max_depth, config, scratch, by_id)
        written = _union(rounds)
    else:
        rounds = _rounds(seeds, graph, max_depth, config, scratch, known)
        visited = _union(rounds)
        stored = hashed(graph.fetched).withColumn("stored", F.lit(True))
        checked = lookup(visited, stored, config, scratch, "left")
        error = F.when(F.col("stored").isNull(), F.lit(MISSING_PAGE)).otherwise(F.col("error"))
        written = scratch.write(
            checked.select(*visited.columns, error.isNull().alias("scraped"), error.alias("error")), "visited"
        )
    tree = written.where("scraped").drop("scraped", "error")
    return Traversal(written.drop("ord", "parent_ord"), tree, len(rounds) - 1)


def numbers_urls(seeds: DataFrame, max_depth: int, config: CrawlConfig) -> bool:
    """Whether the traversal pays for a dictionary, which saves shuffled strings in every round."""
    return max_depth >= config.numbered_from_depth and nb.applies(seeds, config)


def _rounds(
    seeds: DataFrame, graph: LinkGraph, max_depth: int, config: CrawlConfig, scratch: Scratch, known: DataFrame | None
) -> list[DataFrame]:
    """Levels of a traversal that keeps URLs as they are."""
    frontier = _write_frontier(_first_frontier(_starts(seeds, known), config), "crawl_id", scratch)
    rounds = [frontier]
    for _ in range(max_depth):
        seen = _union([r.select(*KEY) for r in rounds] + ([] if known is None else [known]))
        found = _next_frontier(frontier, seen, graph, config)
        frontier = _write_frontier(found, "parent_ord", scratch)
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    return rounds


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def links_found(
    visited: DataFrame, graph: LinkGraph, max_depth: int, config: CrawlConfig
) -> DataFrame:
    """Count of new links per expanded page: ``crawl_id, src_url, depth_left, links``.

    A link counts if it passes the rules and was not visited up to the page's level,
    which is to say that it was visited one level further down.
    """
    sources = visited.where(F.col("scraped") & (F.col("level") < max_depth))
    pairs = _links_of(sources.drop("scraped", "error"), graph, config).select(
        "crawl_id", F.col("url").alias("src_url"), "level", F.col("link").alias("url")
    )
    deeper = visited.select(*KEY, (F.col("level") - 1).alias("level"))
    return (
        pairs.join(deeper, [*KEY, "level"], "left_semi")
        .groupBy("crawl_id", "src_url", (F.lit(max_depth) - F.col("level")).alias("depth_left"))
        .agg(F.countDistinct("url").alias("links"))
    )


# --- nodes and content ----------------------------------------------------------------


def scraped_rows(visited: DataFrame) -> DataFrame:
    """What a node is before its page is looked up."""
    return visited.where("scraped").select(*KEY, "level", "parent_url", "path", "base_url")


def page_nodes(scraped: DataFrame, graph: LinkGraph, config: CrawlConfig) -> DataFrame:
    """Add ``title`` and ``text`` of their pages to ``scraped_rows``.

    Rank or number the rows before, while they are narrow; further columns stay.
    """
    if graph.pages is None:
        raise ValueError("the crawl was made without text")
    found = lookup(scraped, graph.pages, config, graph.scratch)
    named = found.withColumn("title", title(F.col("heading"), F.col("base_url")))
    return named.drop("heading", "base_url")


def named_nodes(scraped: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes whose title and text come from a table ``url, title, text``."""
    return scraped.join(records, "url").drop("base_url")
