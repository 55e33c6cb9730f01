"""One call for a whole crawl: parse, traverse, name the nodes, write the outputs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig
from pageloom.functions import urls
from pageloom.operators import crawl as cr
from pageloom.operators import numbered as nb
from pageloom.operators import report as rp
from pageloom.operators import summary as sm
from pageloom.operators import tree as tr
from pageloom.operators.parse import parse_pages
from pageloom.sources import sinks
from pageloom.sources.indexed import IndexedSnapshot
from pageloom.sources.journal import Journal, fingerprint
from pageloom.sources.packed import write_packed
from pageloom.sources.parsed import ParseStore
from pageloom.sources.scratch import Scratch, bucket_count

LAYOUTS = ("tree", "flat")
FORMATS = {"text": ("text",), "pdf": ("pdf",), "json": ("json",), "both": ("text", "pdf", "json")}


class SeedError(ValueError):
    """A seed is invalid or could not be fetched."""


@dataclass
class SiteCrawl:
    """Result of a crawl. ``visited`` is written; the rest is derived on demand."""

    config: CrawlConfig
    max_depth: int
    graph: cr.LinkGraph
    scratch: Scratch
    seeds: DataFrame
    walked: cr.Traversal
    rejected: DataFrame

    @property
    def visited(self) -> DataFrame:
        return self.walked.visited

    @cached_property
    def nodes(self) -> DataFrame:
        """``crawl_id, url, title, level, parent_url, path, text``."""
        return cr.page_nodes(cr.scraped_rows(self.visited), self.graph, self.config)

    @cached_property
    def ranked_nodes(self) -> DataFrame:
        """Nodes with their tree numbers; numbered before text is attached."""
        ranked = tr.with_tree_numbers(self.walked.tree, self.scratch, self.walked.depth)
        return cr.page_nodes(ranked, self.graph, self.config)

    @cached_property
    def content(self) -> DataFrame:
        return self.nodes.select("crawl_id", "url", "text")

    @cached_property
    def summary(self) -> DataFrame:
        return sm.crawl_summary(self.visited)

    @cached_property
    def levels(self) -> DataFrame:
        return sm.level_progress(self.visited)

    @cached_property
    def failures(self) -> DataFrame:
        return sm.failure_counts(self.visited, self.rejected)

    @cached_property
    def links_found(self) -> DataFrame:
        return cr.links_found(self.visited, self.graph, self.max_depth, self.config)

    @property
    def bases(self) -> DataFrame:
        return self.seeds.groupBy("crawl_id").agg(F.min("base_url").alias("base_url"))


def _needed(snapshot: IndexedSnapshot, seeds: DataFrame, max_depth: int, config: CrawlConfig) -> DataFrame:
    """Pages of an indexed snapshot that a crawl may come to."""
    if not max_depth:
        return snapshot.of_urls(seeds)
    if not (config.same_domain and config.only_base_hosts and nb.applies(seeds, config)):
        return snapshot.all()
    both = seeds.select(F.explode(F.array("url", "base_url")).alias("url"))
    return snapshot.of_hosts(both.select(urls.netloc(F.col("url")).alias("host")))


def crawl_site(
    pages: DataFrame | IndexedSnapshot,
    seeds: DataFrame,
    max_depth: int = 0,
    config: CrawlConfig | None = None,
    known: DataFrame | None = None,
    strict: bool = False,
    journal: str | None = None,
    parse_store: str | None = None,
    text: bool = True,
) -> SiteCrawl:
    """Crawl stored pages from ``seeds(crawl_id, url[, base_url])`` to ``max_depth``.

    ``pages`` has ``url, html`` and may have ``page_id, status, timed_out``. ``known``
    lists pages visited by earlier runs. With ``strict`` a failed seed raises. ``journal``
    names a folder that keeps what a run has finished: the same call made again, also with
    a greater depth, goes on from there. ``parse_store`` names a folder that keeps what pages
    were parsed to, for later runs over pages that are mostly the same. Without ``text`` the
    crawl has no nodes and outputs, only visited pages, links and counts.
    """
    config = config or CrawlConfig()
    seeds = cr.seed_rows(seeds)
    if journal is None:
        scratch = Scratch(pages.sparkSession)
    else:
        numbered = cr.numbers_urls(seeds, max_depth, config)
        stands_for = pages.fingerprint if isinstance(pages, IndexedSnapshot) else pages
        scratch = Journal(pages.sparkSession, journal, fingerprint(config, numbered, text, stands_for, seeds, known))
    buckets = config.buckets
    if isinstance(pages, IndexedSnapshot):
        # The optimizer does not know the size of pages that come by an index.
        buckets = buckets or bucket_count(pages.sparkSession, pages.bytes if max_depth else None)
        pages = _needed(pages, seeds, max_depth, config)
    parse = ParseStore(pages.sparkSession, parse_store).parse if parse_store else parse_pages
    try:
        graph = cr.page_graph(pages, seeds, config.with_(buckets=buckets), scratch, parse, text)
        walked = cr.traversal(seeds, graph, max_depth, config, scratch, known)
    finally:
        scratch.release()
    crawl = SiteCrawl(config, max_depth, graph, scratch, seeds, walked, cr.rejected_seeds(seeds))
    if strict:
        failed = crawl.visited.where((F.col("level") == 0) & ~F.col("scraped")).select("url", "error")
        first = failed.unionByName(crawl.rejected.select("url", "error")).first()
        if first is not None:
            raise SeedError(f"{first['url']}: {first['error']}")
    return crawl


def write_outputs(
    crawl: SiteCrawl,
    formats: str = "text",
    folder: str | None = None,
    generated_at: datetime | None = None,
    layout: str = "tree",
    packed: bool = False,
) -> None:
    """Write 'text', 'pdf' (as page rows), 'json' or, with 'both', all three.

    ``layout`` 'tree' indents text by level and has a contents table; 'flat' lists the pages
    by URL. The JSON is a tree in both. Text and JSON become one folder a crawl or, with
    ``packed``, a report store for any number of crawls.
    """
    if formats not in FORMATS:
        raise ValueError(f"formats must be one of {tuple(FORMATS)}")
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    folder = folder or crawl.config.output_dir
    chosen = FORMATS[formats]
    write = write_packed if packed else sinks.write_blocks

    def written(rows: DataFrame, label: str) -> DataFrame:
        # Written first: the sinks sort by ranges, which reads their input twice.
        return crawl.scratch.write(rows, label)

    if "text" in chosen:
        if layout == "tree":
            write(written(rp.tree_blocks(crawl.nodes), "text_blocks"), ["path"], f"{folder}/scraped_content")
        else:
            write(written(rp.flat_blocks(crawl.content), "text_blocks"), ["url"], f"{folder}/scraped_content")
    if "pdf" in chosen:
        when = generated_at or datetime.now()
        title_rows = rp.title_page(crawl.summary, crawl.bases, when)
        sinks.write_table(title_rows, ["crawl_id", "line_no"], f"{folder}/pages/title_page")
        if layout == "tree":
            table = rp.contents(crawl.nodes, heading=True)
            sinks.write_table(table, ["crawl_id", "path"], f"{folder}/pages/contents")
            pages = rp.tree_pages(crawl.ranked_nodes, crawl.config)
        else:
            numbered = rp.number_pages(cr.scraped_rows(crawl.visited), crawl.scratch)
            pages = rp.flat_pages(cr.page_nodes(numbered, crawl.graph, crawl.config), crawl.config)
        sinks.write_table(written(pages, "page_rows"), ["crawl_id", "doc_page", "line_no"], f"{folder}/pages/body")
    if "json" in chosen:
        blocks = tr.json_blocks(crawl.ranked_nodes).drop("path")
        write(written(blocks, "json_blocks"), ["at", "turn"], f"{folder}/menu_tree")
