"""Levels and parents after a change of some pages, without a new crawl.

A crawl's result is repaired from the top down. At each level only those URLs are looked at
again that a change can have reached: what changed pages of the level above link to now, the
former children of pages that changed, moved or went, and URLs that lost their place and have
not found another yet. Each of them takes the first page of the level above that links to it,
found through its in-links; where there is none it waits for the next level. All other rows
stay as they are and are not computed again. The result equals a crawl from scratch.

``changed`` lists the pages whose stored record differs from that of the earlier run: new, gone,
or with other links or another status. Tables of a level are written, so a lost executor
costs only its own tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.config import CrawlConfig
from pageloom.functions import urls
from pageloom.operators import links as lk
from pageloom.sources.scratch import Scratch, hashed
from pageloom.sources.snapshots import MISSING_PAGE

KEY = ["crawl_id", "url"]
PLACE = [*KEY, "level", "parent_url", "path", "base_url"]


@dataclass(frozen=True)
class Repair:
    """``visited`` as a crawl gives it, and ``touched(level, looked_at, changed)``: how many URLs were
    looked at again for each level, and how many rows of it are new or differ."""

    visited: DataFrame
    touched: DataFrame


def _with_status(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows with ``scraped`` and ``error`` of their pages ``stored(url, now, stored)``."""
    error = F.when(F.col("stored").isNull(), F.lit(MISSING_PAGE)).otherwise(F.col("now"))
    return rows.join(stored, "url", "left").select(*PLACE, error.isNull().alias("scraped"), error.alias("error"))


def _keys(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*KEY) for f in frames]).distinct()


def _found(parents: DataFrame, links: DataFrame, config: CrawlConfig) -> DataFrame:
    """What scraped pages link to, as far as their crawl's rules allow: ``crawl_id, url`` and the parent."""
    above = parents.where("scraped").select(
        "crawl_id", F.col("url").alias("src_url"), F.col("path").alias("above"), "base_url", lk.crawl_base(F.col("base_url"), config).alias("base")
    )
    return above.join(links, "src_url").where(lk.passes_crawl_rules(F.col("url"), F.col("base"), config)).drop("base")


def _placed(asked: DataFrame, above: DataFrame, links: DataFrame, key: Column, level: int, config: CrawlConfig, scratch: Scratch) -> DataFrame:
    """``PLACE`` of the URLs that are asked for, below the first page of the level above that links to them.

    The level is sorted once and its rows numbered in the order of the tree, so the first parent is a
    minimum over longs, which combines before the shuffle; paths return once a URL. In-links meet
    the asked URLs first, so no more of them are shuffled than these have.
    """
    parents = above.where("scraped").select("crawl_id", F.col("url").alias("src_url"), F.col("path").alias("above"), "base_url")
    parents = scratch.write_ordered(parents, "parents", ["above", "crawl_id"])
    base = lk.crawl_base(F.col("base_url"), config)
    slim = hashed(parents.select("crawl_id", "src_url", "ord", "base_url")).withColumn("base", base).drop("base_url")
    into = asked.join(links, "url").join(slim, ["crawl_id", "src_url"]).where(lk.passes_crawl_rules(F.col("url"), F.col("base"), config))
    first = into.groupBy(*KEY).agg(F.min("ord").alias("ord"))
    return first.join(parents.drop("crawl_id"), "ord").select(
        *KEY, F.lit(level).alias("level"), F.col("src_url").alias("parent_url"), F.concat("above", key).alias("path"), "base_url"
    )


def repair(visited: DataFrame, links: DataFrame, fetched: DataFrame, changed: DataFrame, max_depth: int, config: CrawlConfig, scratch: Scratch) -> Repair:
    """Repair ``visited`` after ``changed(url)`` pages.

    ``links(src_url, url)`` and ``fetched(url[, error])`` are those after the change. Seeds and
    ``max_depth`` are those of the earlier crawl.
    """
    if "error" not in fetched.columns:
        fetched = fetched.withColumn("error", F.lit(None).cast("string"))
    old = scratch.write(visited.select(*PLACE, "scraped", "error"), "old_visited")
    changed = scratch.write(changed.select("url").distinct(), "changed")
    # Written once: every level reads them. Repeated links change nothing below.
    links = scratch.write(links.where(lk.passes_page_rules(F.col("url"), config)).select("src_url", "url"), "links")
    stored = fetched.groupBy("url").agg(F.min("error").alias("now")).withColumn("stored", F.lit(True))
    stored = hashed(scratch.write(stored, "stored"))
    key = F.array(urls.sort_key(F.col("url"), config.sort_by_depth))

    def at(level: int) -> DataFrame:
        return old.where(F.col("level") == level)

    def refreshed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that stay, those of changed pages with their status now; and the latter alone."""
        touched = scratch.write(_with_status(rows.join(hashed(changed), "url", "left_semi"), stored), "refreshed")
        return rows.join(hashed(changed), "url", "left_anti").unionByName(touched), touched

    # ``dirty`` pages of the level above give other links or another place to what they link to; ``gone`` are old rows
    # of it that no longer stand. ``placed`` are all rows found so far, ``waiting`` those without a place.
    above, dirty = refreshed(at(0))
    gone, placed, waiting = at(0).limit(0).select(*KEY), old.limit(0), old.limit(0).select(*KEY)
    levels, counts = [above], [dirty.select(F.lit(0).alias("level"), F.lit(0).alias("looked_at"), F.lit(1).alias("changed"))]
    for level in range(1, max_depth + 1):
        moved = scratch.write(_keys(dirty, gone), "moved")
        orphans = at(level).join(moved.withColumnRenamed("url", "parent_url"), ["crawl_id", "parent_url"], "left_semi")
        reached = _found(dirty, links, config)
        asked = scratch.write(_keys(reached, orphans, waiting), "reached")
        # A URL that stands at a higher level keeps its place there.
        stands = old.where(F.col("level") < level).select(*KEY).join(asked, KEY, "left_semi")
        lost = scratch.write(_keys(gone, waiting), "lost")
        settled = stands.join(lost, KEY, "left_anti").unionByName(placed.select(*KEY))
        asked = scratch.write(asked.join(settled, KEY, "left_anti"), "asked")
        rows = old.limit(0).select(*PLACE) if asked.isEmpty() else _placed(asked, above, links, key, level, config, scratch)
        new = scratch.write(_with_status(rows, stored), "placed")
        waiting = scratch.write(asked.join(new, KEY, "left_anti"), "waiting")
        here = at(level)
        gone = scratch.write(_keys(here.join(asked, KEY, "left_semi"), here.join(placed, KEY, "left_semi")), "gone")
        kept, touched = refreshed(here.join(gone, KEY, "left_anti"))
        columns = [F.col(c).alias(f"old_{c}") for c in ("parent_url", "path", "base_url", "scraped", "error")]
        met = new.join(here.select(*KEY, *columns).join(asked, KEY, "left_semi"), KEY, "left")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("parent_url", "path", "base_url", "scraped", "error")])
        differs = met.where(~same).select(*new.columns)
        dirty = scratch.write(differs.unionByName(new.join(changed, "url", "left_semi").select(*new.columns)).distinct().unionByName(touched.select(*new.columns)), "dirty")
        # What found its old place again is not gone.
        gone = scratch.write(gone.join(met.where(same).select(*KEY), KEY, "left_anti"), "gone")
        placed = scratch.write(placed.unionByName(new.select(*placed.columns)), "placed_so_far")
        above = scratch.write(kept.unionByName(new.select(*kept.columns)), "level")
        levels.append(above)
        counts.append(asked.select(F.lit(level).alias("level"), F.lit(1).alias("looked_at"), F.lit(0).alias("changed")))
        counts.append(differs.select(F.lit(level).alias("level"), F.lit(0).alias("looked_at"), F.lit(1).alias("changed")))
        counts.append(touched.select(F.lit(level).alias("level"), F.lit(0).alias("looked_at"), F.lit(1).alias("changed")))
    every = reduce(DataFrame.unionByName, counts)
    touched = every.groupBy("level").agg(F.sum("looked_at").alias("looked_at"), F.sum("changed").alias("changed"))
    return Repair(reduce(DataFrame.unionByName, levels).select(*PLACE, "scraped", "error"), touched)
