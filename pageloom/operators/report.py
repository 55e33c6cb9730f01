"""Report rows: text with and without the tree, page layout, contents, title page."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig
from pageloom.functions import text as tx
from pageloom.operators.layout import LayoutSettings, laid_out
from pageloom.operators.ordinals import with_ordinal
from pageloom.operators.tree import with_preorder_rank
from pageloom.sources.scratch import Scratch

# Texts and widths of the reports.
RULE = "=" * 80
TITLE_LINE = "Web Scraper Output"
DOTS_WIDTH = 50
INDENT_MM = 10
CONTENTS_PAGE = 3
CONTENTS_HEADING = "Table of Contents"


# --- text ------------------------------------------------------------------------------


def tree_blocks(nodes: DataFrame) -> DataFrame:
    """Lines of each node, indented by its level: ``crawl_id, path, lines``."""
    pad = tx.indent(F.col("level"))

    def padded(line: Column) -> Column:
        return F.concat(pad, line)

    header = F.array(
        F.lit(""),
        padded(F.lit(RULE)),
        padded(F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(": "), F.col("title"))),
        padded(F.concat(F.lit("URL: "), F.col("url"))),
        padded(F.lit(RULE)),
        F.lit(""),
    )
    body = F.concat(F.transform(tx.lines(F.col("text")), padded), F.array(F.lit("")))
    return nodes.select("crawl_id", "path", F.concat(header, _or_empty(body)).alias("lines"))


def flat_blocks(content: DataFrame) -> DataFrame:
    """Lines of each page, without a tree: ``crawl_id, url, lines``."""
    header = F.array(F.lit(""), F.lit(RULE), F.concat(F.lit("URL: "), F.col("url")), F.lit(RULE), F.lit(""))
    body = F.concat(header, tx.lines(F.col("text")), F.array(F.lit("")))
    return content.select("crawl_id", "url", body.alias("lines"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """One row per line, numbered from 1 within its block."""
    keys = [name for name in blocks.columns if name != "lines"]
    rows = blocks.select(*keys, F.posexplode("lines").alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def _or_empty(lines: Column) -> Column:
    return F.coalesce(lines, F.array().cast("array<string>"))


# --- page layout -----------------------------------------------------------------------


def _items(kind: str, lines: Column) -> Column:
    return F.transform(lines, lambda line: F.struct(F.lit(kind).alias("kind"), line.alias("text")))


def _body(config: CrawlConfig) -> Column:
    text = tx.ascii_only(F.col("text")) if config.sanitize_body else F.col("text")
    return _or_empty(F.filter(tx.lines(text), tx.nonblank))


def _page_rows(numbered: DataFrame, items: Column) -> DataFrame:
    keys = [name for name in ("crawl_id", "doc_page") if name in numbered.columns]
    return numbered.select(*keys, F.posexplode(items).alias("line_no", "item")).select(
        *keys, (F.col("line_no") + 1).alias("line_no"), "item.kind", "item.text"
    )


def tree_pages(ranked: DataFrame, config: CrawlConfig) -> DataFrame:
    """One document page per ranked node, after the title page and the contents."""
    shown = tx.ascii_only(F.col("title")) if config.sanitize_body else F.col("title")
    head = F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(": "), shown)
    items = F.concat(
        _items("heading", F.array(head)),
        _items("url", F.array(F.concat(F.lit("URL: "), F.col("url")))),
        _items("body", _body(config)),
    )
    return _page_rows(ranked.withColumn("doc_page", F.col("rank") + 2), items)


def number_pages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``rank``, the page's place among its crawl's URLs, from 1."""
    return with_ordinal(pages, ["crawl_id"], ["url"], "rank", scratch)


def flat_pages(numbered: DataFrame, config: CrawlConfig) -> DataFrame:
    """One document page per numbered URL, after the title page."""
    items = F.concat(
        _items("url", F.array(F.concat(F.lit("URL: "), F.col("url")))), _items("body", _body(config))
    )
    return _page_rows(numbered.withColumn("doc_page", F.col("rank") + 1), items)


def plain_page_lines(records: DataFrame, config: CrawlConfig) -> DataFrame:
    """Non-blank lines of each page, nothing else: ``url, line_no, text``."""
    return records.select("url", F.posexplode(_body(config)).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no") + 1
    )


# --- title page and contents -----------------------------------------------------------


def title_page(summary: DataFrame, bases: DataFrame, generated_at: datetime) -> DataFrame:
    """Four lines per crawl: ``crawl_id, line_no, text``.

    ``bases(crawl_id, base_url)`` has one row per crawl.
    """
    lines = F.array(
        F.lit(TITLE_LINE),
        F.concat(F.lit("Base URL: "), F.col("base_url")),
        F.concat(F.lit("Generated: "), F.lit(generated_at.strftime("%Y-%m-%d %H:%M:%S"))),
        F.concat(F.lit("Pages: "), F.col("visited").cast("string")),
    )
    rows = summary.join(bases, "crawl_id").select(
        "crawl_id", F.posexplode(lines).alias("line_no", "text")
    )
    return rows.withColumn("line_no", F.col("line_no") + 1)


def laid_out_nodes(ranked: DataFrame, config: CrawlConfig, scratch: Scratch, layout: LayoutSettings = LayoutSettings()) -> DataFrame:
    """Ranked nodes with ``first_page`` and ``last_page`` of a document whose title page is followed by
    as many contents pages as its entries fill; a node's heading, URL and body lines fill its pages."""
    counted = ranked.withColumn("lines", F.size(_body(config)) + 2)
    narrow = laid_out(counted.select("crawl_id", "rank", "lines"), "crawl_id", ["rank"], "lines", scratch, layout)
    entries = narrow.groupBy("crawl_id").agg(F.ceil(F.count("*") / layout.contents_lines).alias("contents_pages"))
    before = F.col("contents_pages") + 1
    pages = narrow.join(entries, "crawl_id").select("crawl_id", "rank", (F.col("first_page") + before).alias("first_page"), (F.col("last_page") + before).alias("last_page"))
    return ranked.join(pages, ["crawl_id", "rank"])


def contents(nodes: DataFrame, scratch: Scratch | None = None, page_numbers: str = "reference", heading: bool = False) -> DataFrame:
    """Table of contents: ``crawl_id, path, indent_mm, entry``.

    Page numbers are the fixed one that follows a one-page table ('reference'), each node's
    place ('ordinal') or the page it starts on ('laid_out', for ``laid_out_nodes``). With
    ``heading`` each table begins with its heading, whose path is empty.
    """
    if page_numbers == "reference":
        page = F.lit(CONTENTS_PAGE)
    elif page_numbers == "ordinal":
        if "rank" not in nodes.columns:
            nodes = with_preorder_rank(nodes.select("crawl_id", "path", "title", "level"), scratch)
        page = F.col("rank") + 2
    elif page_numbers == "laid_out":
        page = F.col("first_page")
    else:
        raise ValueError("page_numbers must be 'reference', 'ordinal' or 'laid_out'")
    width = F.lit(DOTS_WIDTH) - F.length("title") - F.col("level") * 2
    dots = F.repeat(F.lit("."), F.greatest(F.lit(0), width))
    entry = F.concat(F.col("title"), F.lit(" "), dots, F.lit(" "), page.cast("string"))
    rows = nodes.select(
        "crawl_id", "path", (F.col("level") * INDENT_MM).alias("indent_mm"), entry.alias("entry")
    )
    if not heading:
        return rows
    nothing = F.array().cast("array<string>").alias("path")
    heads = nodes.select("crawl_id").distinct().select("crawl_id", nothing, F.lit(0).alias("indent_mm"), F.lit(CONTENTS_HEADING).alias("entry"))
    return heads.unionByName(rows)
