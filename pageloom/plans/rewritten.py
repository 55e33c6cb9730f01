"""Queries over the stored pages with links of every kind put in front of their markup, by rule.

Page ``n`` moves to ``https://h{n % 5}.example/docs/s{n % 3}/p{n}`` and gets a menu of priority links
(two or three for even numbers, six for odd ones, so that both sides of the fallback rule
occur) and a paragraph of links that other rules decide on. Some pages fail by status or time-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import docs_config
from pageloom.operators import links as lk
from pageloom.operators import summary as sm
from pageloom.operators.parse import parse_pages
from pageloom.plans.site import SiteCrawl, crawl_site
from pageloom.sources.scratch import Scratch
from pageloom.sources.snapshots import page_lookup, read_pages

CONFIG = docs_config(links_from="raw", prefix="seed")


def _text(*parts: str | int | Column) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _anchors(*hrefs: Column) -> Column:
    """Links one after the other; null ones are left out."""
    return F.concat_ws("", *[F.concat(F.lit('<a href="'), href, F.lit('">x</a>')) for href in hrefs])


def pages(spark, sf_dir) -> DataFrame:
    """``page_id, url, base_url, html, status, timed_out`` of the rewritten pages."""
    n = F.col("page_id")
    odd = n % 2 == 1

    def place(step: int) -> Column:
        return _text("s", (n + step) % 3, "/p", n + step)

    menu = _anchors(
        _text("p", n + 15),
        _text("../", place(5)),
        F.when(odd, _text("./p", n + 30)),
        F.when(odd, _text("//h", n % 5, ".example/docs/", place(25))),
        F.when(odd, _text("/docs/", place(10))),
        F.when(odd, _text("../../docs/./", place(20))),
        F.when(n % 4 == 0, F.lit("mailto:w@x.example")),
    )
    others = _anchors(
        _text("/search/p", n),
        _text("./p", n + 45, "#top"),
        _text("../s0/p", n, "?x=1"),
        _text("//h", n, ".example/docs/p"),
        _text("/blog/p", n),
        F.lit("/docs/tel:5"),
        _text("/docs/more/p", n),
    )
    site = _text("https://h", n % 5, ".example")
    return read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id",
        F.concat(site, F.lit("/docs/"), place(0)).alias("url"),
        F.concat(site, F.lit("/docs/")).alias("base_url"),
        F.concat(F.lit('<div class="toc">'), menu, F.lit("</div><p>"), others, F.lit("</p>"), "html").alias("html"),
        F.when(n % 11 == 0, 503).when(n % 13 == 0, 404).otherwise(200).alias("status"),
        (n % 17 == 3).alias("timed_out"),
    )


def rewritten_links(spark, sf_dir):
    found = lk.with_page_links(parse_pages(pages(spark, sf_dir), CONFIG), CONFIG)
    rows = found.select(F.col("url").alias("src_url"), "base_url", F.size("priority_links").alias("n"), F.posexplode("links").alias("pos", "url"))
    verdict = lk.verdict(F.col("url"), F.col("base_url"), CONFIG).alias("verdict")
    return rows.select("src_url", "url", (F.col("pos") < F.col("n")).alias("is_priority"), verdict)


def rewritten_exclusions(spark, sf_dir):
    """Verdicts with a table of excluded entries besides the literal ones: paths of every third part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 = 0")
    entries = part.select(F.concat(F.lit("/p"), F.col("p_partkey").cast("string")).alias("entry"))
    links = rewritten_links(spark, sf_dir).select("src_url", "url")
    site = F.regexp_extract("src_url", "^https://[^/]*/docs/", 0)
    return lk.table_verdicts(links, entries, CONFIG, Scratch(spark), site).select("src_url", "url", "verdict")


SELECTORS = docs_config(
    links_from="raw", prefix="seed", priority_selectors=(), menu_selectors=('div.toc > a[href^="../"], p > a[href]', "#none a", "nav > a")
)


def rewritten_selectors(spark, sf_dir):
    """Links of child steps, attribute tests and selector lists."""
    found = lk.with_page_links(parse_pages(pages(spark, sf_dir), SELECTORS), SELECTORS)
    return found.select(F.col("url").alias("src_url"), F.explode("links").alias("url"))


def rewritten_verdict_counts(spark, sf_dir):
    links = rewritten_links(spark, sf_dir)
    return links.groupBy("verdict", "is_priority").agg(F.count("*").alias("links"))


def rewritten_lookup(spark, sf_dir):
    """Every page and every link, asked for once."""
    requests = pages(spark, sf_dir).select("url").unionByName(rewritten_links(spark, sf_dir).select("url")).distinct()
    return page_lookup(requests, pages(spark, sf_dir), CONFIG).select("url", "scraped", "error", "retryable")


def _crawl(spark, sf_dir) -> SiteCrawl:
    stored = pages(spark, sf_dir)
    seeds = stored.select(F.col("url").alias("crawl_id"), "url", "base_url")
    return crawl_site(stored.drop("base_url"), seeds, 2, CONFIG, text=False)


def rewritten_crawl(spark, sf_dir):
    return _crawl(spark, sf_dir).visited.select("crawl_id", "url", "level", "parent_url", "scraped", "error")


def rewritten_cleaned(spark, sf_dir):
    """Links outside the elements that are dropped."""
    config = CONFIG.with_(links_from="cleaned")
    links = lk.link_rows(lk.with_page_links(parse_pages(pages(spark, sf_dir), config), config))
    return links.select("src_url", "url", "is_priority")


def rewritten_deep(spark, sf_dir):
    """Every tenth page's crawl to depth 4, which numbers its URLs."""
    stored = pages(spark, sf_dir)
    seeds = stored.where("page_id % 10 = 0").select(F.col("url").alias("crawl_id"), "url", "base_url")
    visited = crawl_site(stored.drop("base_url"), seeds, 4, CONFIG, text=False).visited
    return visited.select("crawl_id", "url", "level", "parent_url", F.array_join("path", " > ").alias("path"), "scraped", "error")


def rewritten_failures(spark, sf_dir):
    crawl = _crawl(spark, sf_dir)
    return sm.retryable_failures(crawl.failures)


QUERIES = {q.__name__: q for q in (rewritten_links, rewritten_selectors, rewritten_exclusions, rewritten_verdict_counts, rewritten_lookup, rewritten_cleaned, rewritten_crawl, rewritten_deep, rewritten_failures)}
