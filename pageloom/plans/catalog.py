"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig, docs_config, menu_config, plain_config
from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.operators import crawl as cr
from pageloom.operators import extract as ex
from pageloom.operators import links as lk
from pageloom.operators import repair as rep
from pageloom.operators import report as rp
from pageloom.operators import summary as sm
from pageloom.operators import tree as tr
from pageloom.operators.layout import LayoutSettings
from pageloom.operators.parse import parse_pages
from pageloom.plans import rewritten
from pageloom.plans.site import SiteCrawl, crawl_site, write_outputs
from pageloom.sources.indexed import IndexedSnapshot, write_snapshot
from pageloom.sources.packed import read_index, read_packed, write_packed
from pageloom.sources.parsed import ParseStore
from pageloom.sources.scratch import Scratch
from pageloom.sources.snapshots import page_lookup, read_pages, spread

RAW = docs_config(links_from="raw", prefix="site")
NAV_FIRST = docs_config(links_from="raw", prefix="site", priority_selectors=("nav a",))
GENERATED_AT = datetime(2024, 1, 2, 3, 4, 5)
ROOT = "https://store.example"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def shown_path() -> Column:
    return F.array_join("path", " > ").alias("path")


# --- text and URLs ---------------------------------------------------------------------


def page_text(spark, sf_dir):
    return ex.page_records(pages_of(spark, sf_dir), docs_config()).select("page_id", "url", "title", "text")


def page_text_plain(spark, sf_dir):
    return ex.plain_pages(pages_of(spark, sf_dir)).select("page_id", "url", "text")


def page_failures(spark, sf_dir):
    """Every fifth page under a URL without a scheme, every seventh with markup that cannot be read."""
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    pages = pages_of(spark, sf_dir).withColumns(
        {
            "url": F.when(F.col("page_id") % 5 == 0, bare).otherwise(F.col("url")),
            "html": F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<![bad[x]]>"), "html")).otherwise(F.col("html")),
        }
    )
    failed = ex.plain_pages(pages).where(F.col("error").isNotNull())
    return failed.select("page_id", "url", F.substring_index("error", ":", 1).alias("error"))


def page_title(spark, sf_dir):
    records = ex.page_records(pages_of(spark, sf_dir), docs_config())
    slug = ex.slug_title(F.col("url"))
    return records.select("page_id", "url", "title", slug.alias("slug"), F.length("title").alias("length"))


def clean_documents(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", tx.clean_text(F.col("text")).alias("text"))


def ascii_documents(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", tx.ascii_only(F.col("text")).alias("text"))


def _variants(url: Column) -> Column:
    """The URL itself and forms of it that lack a scheme, a host or both."""
    bare = F.regexp_replace(url, "^[a-z]+://", "")
    forms = {
        "whole": url,
        "no_scheme": F.concat(F.lit("//"), bare),
        "bare": bare,
        "no_host": F.regexp_replace(url, "://[^/?#]*", ":"),
        "mail": F.concat(F.lit("mailto:"), bare),
    }
    return F.map_from_arrays(F.array(*map(F.lit, forms)), F.array(*forms.values()))


def url_validity(spark, sf_dir):
    forms = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(_variants(F.col("url"))).alias("variant", "candidate")
    )
    return forms.withColumn("valid", urls.is_valid_url(F.col("candidate")))


def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.scheme(url).alias("scheme"),
        urls.netloc(url).alias("netloc"),
        urls.path(url).alias("path"),
        urls.query(url).alias("query"),
        urls.fragment(url).alias("fragment"),
        urls.segment_count(url).alias("segments"),
    )


# --- links -----------------------------------------------------------------------------


def _linked(spark, sf_dir, config: CrawlConfig) -> DataFrame:
    return lk.with_page_links(parse_pages(pages_of(spark, sf_dir), config), config)


def page_anchors(spark, sf_dir):
    return lk.anchor_rows(parse_pages(pages_of(spark, sf_dir), RAW), RAW)


def page_links_raw(spark, sf_dir):
    return lk.link_rows(_linked(spark, sf_dir, RAW)).select("src_url", "url")


def page_links_cleaned(spark, sf_dir):
    config = docs_config(prefix="site")
    return lk.link_rows(_linked(spark, sf_dir, config)).select("src_url", "url")


def priority_fallback(spark, sf_dir):
    return _linked(spark, sf_dir, NAV_FIRST).select(
        F.col("url").alias("src_url"),
        F.size("priority_links").alias("priority_links"),
        (F.size("priority_links") < 5).alias("falls_back"),
        F.size("links").alias("links"),
    )


def menu_links(spark, sf_dir):
    config = menu_config(links_from="raw", prefix="site")
    links = lk.link_rows(_linked(spark, sf_dir, config))
    kept = lk.link_verdicts(links, config).where(F.col("verdict") == lk.KEEP)
    return kept.select("src_url", "url")


def link_verdicts(spark, sf_dir):
    links = lk.link_rows(_linked(spark, sf_dir, RAW)).select("src_url", "url")
    modes = [RAW.with_(prefix=mode) for mode in ("seed", "site", "off")]
    labelled = F.array(
        *[
            F.struct(
                F.lit(config.prefix).alias("prefix"),
                lk.verdict(F.col("url"), F.col("src_url"), config).alias("verdict"),
            )
            for config in modes
        ]
    )
    return links.select("src_url", "url", F.inline(labelled))


def verdict_counts(spark, sf_dir):
    return link_verdicts(spark, sf_dir).groupBy("prefix", "verdict").agg(F.count("*").alias("links"))


def visited_verdicts(spark, sf_dir):
    """Links of every page when the links of the first pages of each host were visited."""
    links = lk.link_rows(_linked(spark, sf_dir, RAW)).select("src_url", "url")
    visited = links.groupBy(urls.netloc(F.col("src_url")).alias("host")).agg(F.min("url").alias("url"))
    checked = lk.link_verdicts(links, RAW, visited=visited.select("url"))
    return checked.select("src_url", "url", "verdict")


def ranked_links(spark, sf_dir):
    return lk.ranked_rows(_linked(spark, sf_dir, RAW), RAW)


def lookup_pages(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    linked = lk.link_rows(lk.with_page_links(parse_pages(pages, RAW), RAW)).select("url")
    requests = pages.select("url").unionByName(linked).distinct()
    return page_lookup(requests, pages, RAW).select("url", "scraped", "error")


# --- crawls of pages -------------------------------------------------------------------


def _page_crawl(spark, sf_dir, text: bool = False) -> SiteCrawl:
    pages = pages_of(spark, sf_dir)
    seeds = table(spark, sf_dir, "pages").select(F.col("url").alias("crawl_id"), "url")
    return crawl_site(pages, seeds, 1, RAW, text=text)


def crawl_pages(spark, sf_dir):
    visited = _page_crawl(spark, sf_dir).visited
    return visited.select("crawl_id", "url", "level", "parent_url", "scraped", "error")


def crawl_content(spark, sf_dir):
    return _page_crawl(spark, sf_dir, text=True).nodes.select("crawl_id", "url", "title", "level", "text")


def crawl_summary(spark, sf_dir):
    return _page_crawl(spark, sf_dir).summary


def crawl_levels(spark, sf_dir):
    return _page_crawl(spark, sf_dir).levels


def crawl_errors(spark, sf_dir):
    return _page_crawl(spark, sf_dir).failures


def links_found(spark, sf_dir):
    return _page_crawl(spark, sf_dir).links_found


def title_page(spark, sf_dir):
    crawl = _page_crawl(spark, sf_dir)
    return rp.title_page(crawl.summary, crawl.bases, GENERATED_AT)


# --- crawls of graphs ------------------------------------------------------------------

STORE = docs_config(excluded_paths=(), prefix="seed")
SUPPLY = docs_config(excluded_paths=(), prefix="site")


def _url(*pieces: str | Column) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces]
    return F.concat(F.lit(ROOT), *parts)


def _region(key: Column) -> Column:
    return _url("/r", key)


def _nation(region: Column, key: Column) -> Column:
    return _url("/r", region, "/n", key)


def _store_customers(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "url", _url("/r", F.col("n_regionkey"), "/n", F.col("n_nationkey"), "/c", F.col("c_custkey"))
    )


def _store(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, links and page records of region → nation → customer."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customers = _store_customers(spark, sf_dir)
    region_url = _region(F.col("r_regionkey"))
    nation_url = _nation(F.col("n_regionkey"), F.col("n_nationkey"))
    seeds = region.select(F.lower("r_name").alias("crawl_id"), region_url.alias("url"))
    edges = nation.select(_region(F.col("n_regionkey")).alias("src_url"), nation_url.alias("url")).unionByName(
        customers.select(nation_url.alias("src_url"), "url")
    )
    customer_text = F.concat(F.col("c_name"), F.lit("\n"), F.col("c_mktsegment"))
    records = (
        region.select(region_url.alias("url"), F.col("r_name").alias("title"), F.lit("Region").alias("text"))
        .unionByName(nation.select(nation_url.alias("url"), F.col("n_name").alias("title"), F.lit("Nation").alias("text")))
        .unionByName(customers.select("url", F.col("c_name").alias("title"), customer_text.alias("text")))
    )
    return seeds, edges, records


def _traversal(spark, seeds, edges, stored, depth, config, known=None) -> cr.Traversal:
    scratch, seeds = Scratch(spark), cr.seed_rows(seeds)
    try:
        graph = cr.edge_graph(edges, stored, config, scratch, by_url=not cr.numbers_urls(seeds, depth, config))
        return cr.traversal(seeds, graph, depth, config, scratch, known)
    finally:
        scratch.release()


def _traverse(spark, seeds, edges, stored, depth, config, known=None) -> DataFrame:
    return _traversal(spark, seeds, edges, stored, depth, config, known).visited


def _store_visited(spark, sf_dir) -> DataFrame:
    seeds, edges, records = _store(spark, sf_dir)
    return _traverse(spark, seeds, edges, records.select("url"), 2, STORE)


def _store_nodes(spark, sf_dir) -> DataFrame:
    seeds, edges, records = _store(spark, sf_dir)
    visited = _traverse(spark, seeds, edges, records.select("url"), 2, STORE)
    return cr.named_nodes(cr.scraped_rows(visited), records)


def _store_numbered(spark, sf_dir) -> DataFrame:
    """Nodes with tree numbers."""
    seeds, edges, records = _store(spark, sf_dir)
    walked = _traversal(spark, seeds, edges, records.select("url"), 2, STORE)
    return cr.named_nodes(tr.with_tree_numbers(walked.tree, Scratch(spark), walked.depth), records)


def _visited_columns(visited: DataFrame) -> DataFrame:
    return visited.select("crawl_id", "url", "level", "parent_url", shown_path(), "scraped")


def crawl_hierarchy(spark, sf_dir):
    return _visited_columns(_store_visited(spark, sf_dir))


def crawl_incremental(spark, sf_dir):
    """Customers in debt were visited by an earlier run."""
    seeds, edges, records = _store(spark, sf_dir)
    debtors = _store_customers(spark, sf_dir).where("c_acctbal < 0")
    region = table(spark, sf_dir, "region")
    known = debtors.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("r_name").alias("crawl_id"), "url"
    )
    visited = _traverse(spark, seeds, edges, records.select("url"), 2, STORE, known)
    return _visited_columns(visited)


def _supply(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, links and pages of region → nation → supplier ↔ part, which has cycles."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    lineitem = table(spark, sf_dir, "lineitem")
    seeds = region.select(F.lower("r_name").alias("crawl_id"), _url("/region/", F.col("r_regionkey")).alias("url"))
    part_url = _url("/part/", F.col("l_partkey"))
    supplier_url = _url("/supplier/", F.col("l_suppkey"))
    pairs = lineitem.select("l_partkey", "l_suppkey").distinct()
    both_ways = pairs.select(part_url.alias("part"), supplier_url.alias("supplier")).select(
        F.explode(
            F.array(
                F.struct(F.col("supplier").alias("src_url"), F.col("part").alias("url")),
                F.struct(F.col("part").alias("src_url"), F.col("supplier").alias("url")),
            )
        ).alias("edge")
    )
    edges = (
        nation.select(
            _url("/region/", F.col("n_regionkey")).alias("src_url"), _url("/nation/", F.col("n_nationkey")).alias("url")
        )
        .unionByName(
            supplier.select(
                _url("/nation/", F.col("s_nationkey")).alias("src_url"),
                _url("/supplier/", F.col("s_suppkey")).alias("url"),
            )
        )
        .unionByName(both_ways.select("edge.src_url", "edge.url"))
    )
    stored = (
        seeds.select("url")
        .unionByName(nation.select(_url("/nation/", F.col("n_nationkey")).alias("url")))
        .unionByName(supplier.select(_url("/supplier/", F.col("s_suppkey")).alias("url")))
        .unionByName(table(spark, sf_dir, "part").select(_url("/part/", F.col("p_partkey")).alias("url")))
    )
    return seeds, edges, stored


def crawl_cyclic(spark, sf_dir):
    seeds, edges, stored = _supply(spark, sf_dir)
    return _visited_columns(_traverse(spark, seeds, edges, stored, 4, SUPPLY))


def crawl_repaired(spark, sf_dir):
    """The crawl of ``crawl_cyclic``, repaired after the pages of every seventh part are gone."""
    seeds, edges, stored = _supply(spark, sf_dir)
    scratch = Scratch(spark)
    edges = scratch.write(edges, "supply")  # the crawl and the repair read it
    before = _traverse(spark, seeds, edges, stored, 4, SUPPLY)
    gone = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(_url("/part/", F.col("p_partkey")).alias("url"))
    left = edges.join(gone.withColumnRenamed("url", "src_url"), "src_url", "left_anti")
    fixed = rep.repair(before, left, stored.join(gone, "url", "left_anti"), gone, 4, SUPPLY, scratch)
    return _visited_columns(fixed.visited)


def graph_levels(spark, sf_dir):
    seeds, edges, stored = _supply(spark, sf_dir)
    return sm.level_progress(_traverse(spark, seeds, edges, stored, 4, SUPPLY))


# --- tree and reports ------------------------------------------------------------------


def tree_nodes(spark, sf_dir):
    return _store_nodes(spark, sf_dir).select("crawl_id", "url", "title", "level", "parent_url", shown_path())


def tree_children(spark, sf_dir):
    return tr.children(_store_numbered(spark, sf_dir), Scratch(spark))


def tree_json(spark, sf_dir):
    lines = tr.json_lines(_store_numbered(spark, sf_dir))
    return lines.select("crawl_id", shown_path(), "line_no", "line")


def tree_text(spark, sf_dir):
    lines = rp.block_lines(rp.tree_blocks(_store_nodes(spark, sf_dir)))
    return lines.select("crawl_id", shown_path(), "line_no", "line")


def contents(spark, sf_dir):
    nodes = _store_nodes(spark, sf_dir)
    return rp.contents(nodes).select("crawl_id", shown_path(), "indent_mm", "entry")


def contents_numbered(spark, sf_dir):
    rows = rp.contents(_store_numbered(spark, sf_dir), None, "ordinal")
    return rows.select("crawl_id", shown_path(), "indent_mm", "entry")


# So few lines a page that customers take two pages, and contents several.
SHORT_PAGES = LayoutSettings(lines=3, contents_lines=40)


def contents_laid_out(spark, sf_dir):
    scratch = Scratch(spark)
    nodes = rp.laid_out_nodes(scratch.write(_store_numbered(spark, sf_dir), "nodes"), STORE, scratch, SHORT_PAGES)
    rows = rp.contents(nodes, page_numbers="laid_out", heading=True)
    return rows.select("crawl_id", shown_path(), "indent_mm", "entry")


def report_pages(spark, sf_dir):
    return rp.tree_pages(_store_numbered(spark, sf_dir), STORE)


def _flat_content(spark, sf_dir) -> DataFrame:
    records = ex.page_records(pages_of(spark, sf_dir), docs_config())
    read = records.where(F.col("error").isNull())
    return read.select(urls.netloc(F.col("url")).alias("crawl_id"), "url", "text")


def flat_text(spark, sf_dir):
    return rp.block_lines(rp.flat_blocks(_flat_content(spark, sf_dir)))


def report_pages_flat(spark, sf_dir):
    scratch = Scratch(spark)
    content = scratch.write(_flat_content(spark, sf_dir), "content")
    numbered = rp.number_pages(content.select("crawl_id", "url"), scratch)
    return rp.flat_pages(numbered.join(content, ["crawl_id", "url"]), docs_config())


def report_pages_plain(spark, sf_dir):
    return rp.plain_page_lines(ex.plain_pages(pages_of(spark, sf_dir)), plain_config())


# --- sinks -----------------------------------------------------------------------------


def packed_outputs(spark, sf_dir):
    """Text and JSON of the store's crawls, packed, and what the indexes say of them."""
    scratch = Scratch(spark)
    nodes = scratch.write(_store_numbered(spark, sf_dir), "nodes")
    write_packed(rp.tree_blocks(nodes), ["path"], f"{scratch.folder}/text")
    write_packed(tr.json_blocks(nodes), ["at", "turn"], f"{scratch.folder}/json")
    both = [read_index(spark, f"{scratch.folder}/{name}").withColumn("output", F.lit(name)) for name in ("text", "json")]
    rows = both[0].unionByName(both[1])
    return rows.groupBy("crawl_id", "output").agg(F.sum("length").alias("bytes"))


def packed_lines(spark, sf_dir):
    """Lines of one crawl in two, read back by their ranges, and how often each occurs."""
    scratch = Scratch(spark)
    nodes = scratch.write(_store_numbered(spark, sf_dir), "nodes")
    write_packed(tr.json_blocks(nodes), ["at", "turn"], f"{scratch.folder}/json")
    wanted = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.lower("r_name").alias("crawl_id"))
    texts = read_packed(spark, f"{scratch.folder}/json", wanted)
    lines = texts.select("crawl_id", F.explode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("line"))
    return lines.groupBy("crawl_id", "line").agg(F.count("*").alias("n"))


def flat_outputs(spark, sf_dir):
    """Text of every page's own crawl, written flat by ``write_outputs`` and read back."""
    crawl = _page_crawl(spark, sf_dir, text=True)
    folder = f"{crawl.scratch.folder}/out"
    write_outputs(crawl, "text", folder, layout="flat", packed=True)
    texts = read_index(spark, f"{folder}/scraped_content")
    return texts.groupBy("crawl_id").agg(F.sum("length").alias("bytes"))


# --- sources ---------------------------------------------------------------------------


def _snapshot(spark, sf_dir) -> IndexedSnapshot:
    folder = Scratch(spark).folder
    write_snapshot(pages_of(spark, sf_dir), folder)
    return IndexedSnapshot(spark, folder)


def indexed_content(spark, sf_dir):
    """Every fifth page, crawled alone from an indexed snapshot, which reads those pages only."""
    wanted = table(spark, sf_dir, "pages").where("page_id % 5 = 0")
    crawl = crawl_site(_snapshot(spark, sf_dir), wanted.select(F.col("url").alias("crawl_id"), "url"), 0, RAW)
    nodes = crawl.nodes.select("crawl_id", "url", "title", "text")
    return wanted.select("page_id", "url").join(nodes, "url")


def indexed_hosts(spark, sf_dir):
    """Pages of the hosts of every tenth page, found through the index."""
    host = urls.netloc(F.col("url")).alias("host")
    found = _snapshot(spark, sf_dir).of_hosts(table(spark, sf_dir, "pages").where("page_id % 10 = 0").select(host))
    return found.select("page_id", "url", "host", F.octet_length("html").cast("bigint").alias("bytes"))


def parsed_content(spark, sf_dir):
    """Page records by way of a parse store that already holds every second page."""
    pages, store = pages_of(spark, sf_dir), ParseStore(spark, Scratch(spark).folder)
    config = docs_config(menu_selectors=(), priority_selectors=())
    store.parse(pages.where("page_id % 2 = 0"), config)
    records = ex.page_records(pages, config, parse=store.parse)
    return records.select("page_id", "url", "text", "title")


QUERIES = {
    query.__name__: query
    for query in (
        page_text,
        page_text_plain,
        page_failures,
        page_title,
        clean_documents,
        ascii_documents,
        url_validity,
        url_parts,
        page_anchors,
        page_links_raw,
        page_links_cleaned,
        priority_fallback,
        menu_links,
        link_verdicts,
        verdict_counts,
        visited_verdicts,
        ranked_links,
        lookup_pages,
        crawl_pages,
        crawl_content,
        crawl_summary,
        crawl_levels,
        crawl_errors,
        links_found,
        title_page,
        crawl_hierarchy,
        crawl_incremental,
        crawl_cyclic,
        crawl_repaired,
        graph_levels,
        tree_nodes,
        tree_children,
        tree_json,
        tree_text,
        contents,
        contents_numbered,
        contents_laid_out,
        report_pages,
        flat_text,
        report_pages_flat,
        report_pages_plain,
        indexed_content,
        indexed_hosts,
        parsed_content,
        packed_outputs,
        packed_lines,
        flat_outputs,
    )
} | rewritten.QUERIES
